"""Quantities recorded in different units, brought to one unit per quantity (problem 6).

Every claim's unit is chosen by a physical identity in logarithms, ``ln value + ln factor(unit) - ln
reference = 0``: of the units that the quantity can have, the one of least cost.  The cost is the
residual of the identity, and ``EVIDENCE`` for a unit that the claim's unit column, or else its span,
contradicts: a spelling is evidence, and yields where the quantity's values speak against it by more than
that.  The reference is the median of the quantity over the claims as they are spelled; for a claim that
names no unit, another claim of the same chunk and quantity within the tolerance goes before it.
Candidates of another factor that fit about as well make a choice without spelling non-unique, which is
flagged and leaves the claim without a common value.

``identity_units`` is the general form: for columns bound by a product identity (mass = density x
volume), it chooses the combination of units with the least median log residual.

Defined cases: null values stay null; unknown units and quantities give null common values; zero and
negative values are converted but take no part in inference and pairs; repeated rows are kept.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, functions as F

from tarnwell.runtime import cut

# The common unit of each quantity, and how many of it one of each unit is.
COMMON = {
    "systolic_blood_pressure": ("mmHg", {"mmhg": 1.0, "cmhg": 10.0, "kpa": 7.500616827}),
    "egfr": ("mL/min/1.73 m2", {"ml/min": 1.0, "ml/s": 60.0}),
    "acr": ("mg/g", {"mg/g": 1.0, "ug/mg": 1.0, "g/g": 1000.0, "mg/mg": 1000.0, "mg/mmol": 8.84}),
    "kidney_failure_risk": ("%", {"%": 1.0, "‰": 0.1, "fraction": 100.0}),
    "potassium": ("mmol/L", {"mmol/l": 1.0, "meq/l": 1.0, "umol/l": 0.001, "mg/dl": 0.25577}),
    "protein_intake": ("g/kg a day", {"g/kg": 1.0, "mg/kg": 0.001, "g/lb": 2.2046226}),
    "ferritin": ("ng/mL", {"ng/ml": 1.0, "ug/l": 1.0, "mg/l": 1000.0, "ug/dl": 10.0}),
    "haemoglobin": ("g/L", {"g/l": 1.0, "mg/ml": 1.0, "g/dl": 10.0, "g/ml": 1000.0}),
}
# Spellings of units and their parts, tried in this order on lower-case text.
SPELLINGS = [
    (r"[µμ]", "u"),
    (r"²", "2"),
    (r"expressed as a fraction of one|proportion", "fraction"),
    (r"per thousand people|per thousand|per 1,?000", "‰"),
    (r"per ?cent", "%"),
    (r"(?:cm|centimet(?:re|er)s?) ?(?:of mercury|hg)", "cmhg"),
    (r"(?:mm|millimet(?:re|er)s?) *(?:of mercury|hg)", "mmhg"),
    (r"kilopascals?", "kpa"),
    (r"millilit(?:re|er)s?", "ml"),
    (r"decilit(?:re|er)s?", "dl"),
    (r"lit(?:re|er)s?", "l"),
    (r"millimoles?", "mmol"),
    (r"micromoles?", "umol"),
    (r"milliequivalents?", "meq"),
    (r"micrograms?|mcg", "ug"),
    (r"nanograms?", "ng"),
    (r"milligrams?", "mg"),
    (r"kilograms?", "kg"),
    (r"grams?", "g"),
    (r"pounds?", "lb"),
    (r"minutes?", "min"),
    (r"seconds?", "s"),
    (r"of body weight", ""),
    (r"(?:\ba|per|/) ?day\b", ""),
    (r"(?:per|/) ?1\.73 ?m2", ""),
    (r"\bper\b", "/"),
    (r"\s+", ""),
]
# Directions of comparators.
DIRECTIONS = {
    "below": ["<", "<=", "≤", "less than", "lower than", "below", "under", "at most", "up to", "no more than", "fewer than"],
    "above": [">", ">=", "≥", "greater than", "more than", "higher than", "above", "over", "at least", "no less than"],
    "between": ["between"],
    "equal": ["=", "equal", "equal to", "equals"],
}
TOLERANCE = 0.01
#: what a unit costs that the claim's own spelling contradicts, in nats: its values must be 2,000 times off
EVIDENCE = math.log(2000.0)
#: Two candidate units whose log residuals differ by less are not told apart.
APART = math.log(3.0)

_NUMBER = r"\d[\d.,]*(?:e[+-]?\d+)?"
_STATED = rf"(?i)(?:<=|>=|[<>≤≥=]|than|over|under|above|below|at least|at most|between {_NUMBER} and)\s*{_NUMBER}\s*(.*)$"


def unit_keys(*units: Column) -> Column:
    """Spellings of units in their one short form, as an array; null for missing ones (null, blank,
    ``-``).  The patterns run once over all of them, parted by a character that none matches."""
    u = F.lower(F.concat_ws("\u0001", *[F.coalesce(F.trim(x), F.lit("")) for x in units]))
    for pattern, to in SPELLINGS:
        u = F.regexp_replace(u, pattern, to)
    return F.transform(F.split(u, "\u0001"), lambda k: F.when(~k.isin("", "-"), k))


def span_unit(span: Column) -> Column:
    """The unit named behind the (last) number of a claim's span."""
    rest = F.regexp_extract(span, _STATED, 1)
    return F.regexp_replace(rest, r"(?: \(| for [a-z]).*$|\.\s*$", "")


def direction(comparator: Column) -> Column:
    c = F.regexp_replace(F.lower(F.trim(comparator)), r"\s+", " ")
    out = F.lit(None).cast("string")
    for name, words in DIRECTIONS.items():
        out = F.when(c.isin(*words), name).otherwise(out)
    return out


def _factors() -> dict[str, dict[str, float]]:
    return {q: units for q, (_, units) in COMMON.items()}


def factor(quantity: Column, key: Column) -> Column:
    table = F.create_map(*[F.lit(x) for q, units in _factors().items() for u, f in units.items() for x in (f"{q}|{u}", f)])
    return table[F.concat_ws("|", quantity, F.coalesce(key, F.lit("")))]


def common_unit(quantity: Column) -> Column:
    return F.create_map(*[F.lit(x) for q, (u, _) in COMMON.items() for x in (q, u)])[quantity]


def _bucket(v: Column, tolerance: float = TOLERANCE) -> Column:
    return F.floor(F.log(v) / math.log1p(tolerance))


def common_claims(claims: DataFrame) -> DataFrame:
    """Every claim with ``direction``, ``unit_key``, ``common_value``, ``common_high``, ``common_unit``
    and ``unit_source``: column, span, contradicted (another unit than spelled), inferred, ambiguous or unknown."""
    parsed = claims.select(
        "claim_id", "quantity", "comparator", "value", "value_high", "unit", "document_id", "chunk_id",
        direction(F.col("comparator")).alias("direction"), unit_keys(F.col("unit"), span_unit(F.coalesce("span", F.lit("")))).alias("keys"),
    )
    looked = parsed.withColumn("factors", F.transform("keys", lambda k: factor(F.col("quantity"), k)))
    given, said = F.col("factors")[0].isNotNull(), F.col("factors")[1].isNotNull()
    base = looked.select(
        *parsed.drop("keys").columns,
        F.when(given, F.col("keys")[0]).when(said, F.col("keys")[1]).alias("unit_key"),
        F.coalesce(F.col("factors")[0], F.col("factors")[1]).alias("factor"),
        F.when(given, "column").when(said, "span").otherwise("unknown").alias("unit_source"),
    )
    base = cut(base)  # read four times below, parsed once
    known = base.where("factor is not null")
    medians = known.where("value > 0").groupBy("quantity").agg(F.percentile_approx(F.log(F.col("value") * F.col("factor")), 0.5, 10_000).alias("median"))
    medians = medians.where(F.col("quantity").isin(*COMMON))  # a row for each quantity of the table above
    return _converted(_weighed(known, medians)).unionByName(_converted(_inferred(base.where("factor is null"), known, medians)))


def _candidates(quantity: Column) -> Column:
    """The distinct factors of a quantity's units, each with the name of one of them."""
    return F.create_map(*[
        x for q, units in _factors().items()
        for x in (F.lit(q), F.array(*[F.struct(F.lit(f).alias("f"), F.lit(min(u for u, g in units.items() if g == f)).alias("u")) for f in sorted(set(units.values()))]))
    ])[quantity]


def _weighed(known: DataFrame, medians: DataFrame) -> DataFrame:
    """Claims that spell a unit, with the unit of least cost: no shuffle, a claim meets its quantity's median."""
    own = F.col("factor")

    def cost(c: Column) -> Column:
        other = (c["f"] != own).cast("int")
        return F.struct((F.abs(F.log("value") + F.log(c["f"]) - F.col("median")) + other * F.lit(EVIDENCE)).alias("cost"), other.alias("other"), c["f"].alias("f"), c["u"].alias("u"))

    best = F.array_min(F.transform(_candidates(F.col("quantity")), cost))
    w = known.join(F.broadcast(medians), "quantity", "left").withColumn("best", F.when((F.col("value") > 0) & F.col("median").isNotNull(), best))
    changed = F.coalesce(F.col("best.other") == 1, F.lit(False))
    return w.select(
        *[c for c in known.columns if c not in ("factor", "unit_key", "unit_source")],
        F.when(changed, F.col("best.f")).otherwise(own).alias("factor"), F.when(changed, F.col("best.u")).otherwise(F.col("unit_key")).alias("unit_key"),
        F.when(changed, "contradicted").otherwise(F.col("unit_source")).alias("unit_source"),
    )


def _converted(df: DataFrame) -> DataFrame:
    return df.select(
        "claim_id", "quantity", "comparator", "direction", "value", "value_high", "unit", "unit_key", "document_id", "chunk_id", "unit_source",
        (F.col("value") * F.col("factor")).alias("common_value"),
        (F.col("value_high") * F.col("factor")).alias("common_high"),
        F.when(F.col("factor").isNotNull(), common_unit(F.col("quantity"))).alias("common_unit"),
    )


def _inferred(lost: DataFrame, known: DataFrame, medians: DataFrame) -> DataFrame:
    """Claims without any unit, with the factor of the candidate that fits the identity best."""
    candidates = _candidates(F.col("quantity"))
    c = (
        lost.where("value > 0").select("claim_id", "chunk_id", "quantity", "value", F.explode(candidates).alias("c"))
        .select("claim_id", "chunk_id", "quantity", "c.f", "c.u", F.log(F.col("value") * F.col("c.f")).alias("ln"))
    )
    positive = known.where("value > 0").select("chunk_id", "quantity", (F.col("value") * F.col("factor")).alias("common"))
    # One row per chunk, quantity and 1 % step of value, however many claims there are.
    peers = positive.groupBy("chunk_id", "quantity", _bucket(F.col("common")).alias("b")).agg(F.log(F.min("common")).alias("lo"), F.log(F.max("common")).alias("hi"))
    near = c.withColumn("b", F.explode(F.sequence(_bucket(F.exp("ln")) - 1, _bucket(F.exp("ln")) + 1)))
    beside = (
        near.join(peers, ["chunk_id", "quantity", "b"])
        .groupBy("claim_id", "f").agg(F.min(F.greatest(F.col("lo") - F.col("ln"), F.col("ln") - F.col("hi"), F.lit(0.0))).alias("residual"))
        .where(F.col("residual") <= math.log1p(TOLERANCE)).withColumn("peer", F.lit(0))
    )
    overall = c.join(F.broadcast(medians), "quantity").select("claim_id", "f", F.abs(F.col("ln") - F.col("median")).alias("residual"), F.lit(1).alias("peer"))
    fits = overall.unionByName(beside).groupBy("claim_id", "f").agg(F.min(F.struct("peer", "residual")).alias("fit"))
    chosen = (
        fits.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("fit", "f"))).alias("all"))  # at most five candidates
        .select(
            "claim_id", F.col("all")[0]["f"].alias("best"),
            (
                (F.size("all") > 1)
                & (F.get("all", F.lit(1))["fit"]["peer"] == F.col("all")[0]["fit"]["peer"])
                & (F.get("all", F.lit(1))["fit"]["residual"] - F.col("all")[0]["fit"]["residual"] < F.when(F.col("all")[0]["fit"]["peer"] == 0, 0.0).otherwise(APART))
            ).alias("tied"),
        )
    )
    named = F.filter(candidates, lambda x: x["f"] == F.col("best"))
    return lost.drop("factor", "unit_key", "unit_source").join(chosen, "claim_id", "left").select(
        "*",
        F.when(~F.col("tied"), F.col("best")).alias("factor"),
        F.when(~F.col("tied"), F.get(named, F.lit(0))["u"]).alias("unit_key"),
        F.when(F.col("best").isNull(), "unknown").when(F.col("tied"), "ambiguous").otherwise("inferred").alias("unit_source"),
    ).drop("best", "tied")


def same_bounds(claims: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(id_a, id_b): claims of one chunk and quantity that state the same bound in different numbers.

    Claims are reduced to distinct statements.  The same bound in different numbers takes two units, so
    statements meet by the logarithm of their common value in steps of the tolerance *and* by the other
    unit's factor: pairs of one unit are never formed, and only pairs of statements that hold are
    expanded to rows."""
    c = common_claims(claims).where("value is not null and direction is not null and common_value > 0 and value > 0 and chunk_id is not null and claim_id is not null")
    bound = ["chunk_id", "quantity", "direction"]
    c = c.withColumn("sid", F.xxhash64("quantity", "direction", "value", "value_high", "common_value", "common_high"))
    factor_ = F.round(F.col("common_value") / F.col("value"), 9)
    d = c.select(*bound, "sid", "value", "value_high", "common_value", "common_high", factor_.alias("f"), _bucket(F.col("common_value"), tolerance).alias("b")).dropDuplicates(["chunk_id", "sid"])
    others = F.create_map(*[x for q, units in _factors().items() for x in (F.lit(q), F.array(*[F.lit(round(f, 9)) for f in sorted(set(units.values()))]))])
    fields = ["sid", "value", "common_value", "common_high"]
    # the b side meets its own step and both neighbours: within 1 % is at most one step away
    a = d.select(*bound, *[F.col(x).alias(f"{x}_a") for x in fields], F.explode(F.filter(others[F.col("quantity")], lambda f: f > F.col("f"))).alias("f"), "b")
    a = a.withColumn("b", F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)))
    b = d.select(*bound, *[F.col(x).alias(f"{x}_b") for x in fields], "f", "b")

    def close(x: str, y: str) -> Column:
        return F.abs(F.col(x) - F.col(y)) <= (F.lit(tolerance) * F.greatest(F.abs(x), F.abs(y)) + 1e-12)

    both_high = (F.col("common_high_a").isNull() & F.col("common_high_b").isNull()) | (F.col("common_high_a").isNotNull() & F.col("common_high_b").isNotNull() & close("common_high_a", "common_high_b"))
    pairs = a.join(b, [*bound, "f", "b"]).where(close("common_value_a", "common_value_b") & ~close("value_a", "value_b") & both_high).select("chunk_id", "sid_a", "sid_b")
    x = c.select("chunk_id", F.col("sid").alias("sid_a"), F.col("claim_id").alias("x"))
    y = c.select("chunk_id", F.col("sid").alias("sid_b"), F.col("claim_id").alias("y"))
    return pairs.join(x, ["chunk_id", "sid_a"]).join(y, ["chunk_id", "sid_b"]).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def identity_units(df: DataFrame, by: list[str], columns: dict[str, tuple[float, dict[str, float]]], apart: float = 0.02) -> DataFrame:
    """Units of columns bound by ``sum(exponent * ln(value * factor)) = 0``, one choice per group ``by``.

    ``columns`` maps a column to its exponent and its candidate units with factors.  Gives (*by,
    units MAP, residual, unique): the combination with the least median absolute log residual, and
    whether no other combination comes within ``apart`` of it.  Rows with nulls or values not above
    zero in any of the columns take no part."""
    names = list(columns)
    logs = [F.log(F.col(n)) * F.lit(columns[n][0]) for n in names]
    rows = df.where(" and ".join(f"`{n}` > 0" for n in names)).select(*by, sum(logs[1:], logs[0]).alias("ln"))
    combos = [
        F.struct(
            F.create_map(*[x for n, u in zip(names, units, strict=True) for x in (F.lit(n), F.lit(u))]).alias("units"),
            F.lit(sum(columns[n][0] * math.log(columns[n][1][u]) for n, u in zip(names, units, strict=True))).alias("shift"),
        )
        for units in itertools.product(*[columns[n][1] for n in names])
    ]
    # The combinations' shifts are constants, so the median is taken once per distinct shift and group.
    each = rows.select(*by, "ln", F.explode(F.array(*combos)).alias("c")).select(*by, F.abs(F.col("ln") + F.col("c.shift")).alias("residual"), F.map_entries("c.units").alias("units"))
    fit = each.groupBy(*by, "units").agg(F.percentile_approx("residual", 0.5, 10_000).alias("residual"))
    best = fit.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("residual", "units"))).alias("all"))
    return best.select(
        *by, F.map_from_entries(F.col("all")[0]["units"]).alias("units"), F.col("all")[0]["residual"].alias("residual"),
        (F.coalesce(F.get("all", F.lit(1))["residual"], F.lit(math.inf)) - F.col("all")[0]["residual"] > apart).alias("unique"),
    )


def spelled_units(claims: DataFrame, apart: float = 0.5) -> DataFrame:
    """(quantity, spelling, unit, residual, unique): what each spelling of each quantity's unit column is by
    the identity alone: over all claims that spell it so, the unit whose values fit the quantity's median
    with the least median residual, by ``identity_units``, and whether no other unit fits about as well."""
    c = common_claims(claims).where("common_value > 0 and value > 0")
    medians = c.groupBy("quantity").agg(F.exp(F.percentile_approx(F.log("common_value"), 0.5, 10_000)).alias("reference")).where(F.col("quantity").isin(*COMMON))
    rows = c.join(F.broadcast(medians), "quantity").select("quantity", F.coalesce(F.lower(F.trim("unit")), F.lit("")).alias("spelling"), "value", "reference")
    out = None
    for q, (_, units) in COMMON.items():
        one = {min(u for u, g in units.items() if g == f): f for f in sorted(set(units.values()))}
        fit = identity_units(rows.where(F.col("quantity") == q), ["quantity", "spelling"], {"value": (1.0, one), "reference": (-1.0, {"": 1.0})}, apart)
        fit = fit.select("quantity", "spelling", F.col("units")["value"].alias("unit"), F.round("residual", 4).alias("residual"), "unique")
        out = fit if out is None else out.unionByName(fit)
    return out
