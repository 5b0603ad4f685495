"""All queries of the core engine and their SQL equivalents."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from tarnwell.operators import units
from tarnwell.sources import table

PLANS = ("text", "retrieval", "evaluation", "answers", "corpus", "relational")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return units.same_bounds(table(spark, d, "claim"))


def p6_common(spark: SparkSession, d: str) -> DataFrame:
    return units.common_claims(table(spark, d, "claim")).select("claim_id", "direction", "common_value", "common_high", "common_unit", "unit_source")


def _spelled(unit: str) -> str:
    """The unit key of ``units.unit_key`` in SQL."""
    u = f"lower(trim({unit}))"
    for pattern, to in units.SPELLINGS:
        u = f"regexp_replace({u}, '{pattern}', '{to}', 'g')"
    return f"nullif(nullif({u}, ''), '-')"


def p6_units(spark: SparkSession, d: str) -> DataFrame:
    return units.spelled_units(table(spark, d, "claim"))


def _claims_sql() -> str:
    """Claims with their factor ``f``: of least cost where a unit is spelled, else by the identity."""
    factors = ", ".join(f"('{q}', '{u}', {f!r}::DOUBLE)" for q, (_, us) in units.COMMON.items() for u, f in us.items())
    ways = ", ".join(f"('{w}', '{name}')" for name, words in units.DIRECTIONS.items() for w in words)
    common = ", ".join(f"('{q}', '{u}')" for q, (u, _) in units.COMMON.items())
    said = _spelled(f"regexp_replace(regexp_extract(span, '{units._STATED}', 1), '(?: \\(| for [a-z]).*$|\\.\\s*$', '')")
    step = f"{units.math.log1p(units.TOLERANCE)!r}"
    return f"""WITH f(q, u, f) AS (VALUES {factors}), w(c, direction) AS (VALUES {ways}), cu(q, unit) AS (VALUES {common}), d AS (SELECT DISTINCT q, f FROM f),
k AS (SELECT *, {_spelled("unit")} AS given, {said} AS said FROM claim),
s AS (SELECT k.claim_id, k.chunk_id, k.quantity, w.direction, k.value, k.value_high, coalesce(g.f, s.f) AS own, CASE WHEN g.f IS NOT NULL THEN 'column' WHEN s.f IS NOT NULL THEN 'span' END AS named
  FROM k LEFT JOIN f g ON g.q = quantity AND g.u = given LEFT JOIN f s ON s.q = quantity AND s.u = said LEFT JOIN w ON w.c = lower(trim(comparator))),
m AS (SELECT quantity, quantile_disc(ln(value * own), 0.5) AS median FROM s WHERE own IS NOT NULL AND value > 0 GROUP BY 1),
a AS (SELECT claim_id, own, named, arg_min(d.f, (abs(ln(value) + ln(d.f) - median) + (d.f <> own)::INT * {units.EVIDENCE!r}, (d.f <> own)::INT, d.f)) AS f FROM s JOIN m USING (quantity) JOIN d ON d.q = quantity WHERE own IS NOT NULL AND value > 0 GROUP BY ALL),
p AS (SELECT chunk_id, quantity, floor(ln(value * own) / {step}) AS b, ln(min(value * own)) AS lo, ln(max(value * own)) AS hi FROM s WHERE own IS NOT NULL AND value > 0 GROUP BY ALL),
l AS (SELECT claim_id, chunk_id, quantity, d.f, ln(value * d.f) AS x FROM s JOIN d ON d.q = quantity WHERE own IS NULL AND value > 0),
fit AS (SELECT claim_id, f, 0 AS peer, min(greatest(lo - x, x - hi, 0.0)) AS r FROM l JOIN p ON p.chunk_id = l.chunk_id AND p.quantity = l.quantity AND abs(p.b - floor(ln(exp(x)) / {step})) <= 1 GROUP BY ALL HAVING min(greatest(lo - x, x - hi, 0.0)) <= {step}
  UNION ALL SELECT claim_id, f, 1, abs(x - median) FROM l JOIN m USING (quantity)),
best AS (SELECT claim_id, f, min((peer, r)) AS fit FROM fit GROUP BY ALL),
o AS (SELECT claim_id, list(struct_pack(p := fit[1], r := fit[2], f := f) ORDER BY fit, f) AS fits FROM best GROUP BY ALL),
i AS (SELECT claim_id, fits[1].f AS f, len(fits) > 1 AND fits[2].p = fits[1].p AND fits[2].r - fits[1].r < CASE WHEN fits[1].p = 0 THEN 0.0 ELSE {units.APART!r} END AS tied FROM o),
c AS (SELECT s.claim_id, s.chunk_id, s.quantity, s.direction, s.value, s.value_high, CASE WHEN s.own IS NOT NULL THEN coalesce(a.f, s.own) WHEN NOT i.tied THEN i.f END AS f,
  CASE WHEN s.own IS NOT NULL THEN CASE WHEN a.f <> s.own THEN 'contradicted' ELSE s.named END WHEN i.f IS NULL THEN 'unknown' WHEN i.tied THEN 'ambiguous' ELSE 'inferred' END AS unit_source
  FROM s LEFT JOIN a ON a.claim_id = s.claim_id LEFT JOIN i ON i.claim_id = s.claim_id)"""


def _p6_sql() -> str:
    """Pairs within a chunk and quantity."""
    return _claims_sql() + """ SELECT a.claim_id AS id_a, b.claim_id AS id_b FROM c a JOIN c b ON a.chunk_id = b.chunk_id AND a.quantity = b.quantity AND a.direction = b.direction AND a.claim_id < b.claim_id
WHERE abs(a.value * a.f - b.value * b.f) <= 0.01 * greatest(a.value * a.f, b.value * b.f) + 1e-12 AND abs(a.value - b.value) > 0.01 * greatest(a.value, b.value)
 AND ((a.value_high IS NULL AND b.value_high IS NULL) OR abs(a.value_high * a.f - b.value_high * b.f) <= 0.01 * greatest(a.value_high * a.f, b.value_high * b.f) + 1e-12)"""


def _p6_common_sql() -> str:
    return _claims_sql() + """ SELECT claim_id, direction, value * f AS common_value, value_high * f AS common_high, CASE WHEN f IS NOT NULL THEN cu.unit END AS common_unit, unit_source FROM c LEFT JOIN cu ON cu.q = quantity"""


def _p6_units_sql() -> str:
    names = ", ".join(f"('{q}', '{min(u for u, g in us.items() if g == f)}', {f!r}::DOUBLE)" for q, (_, us) in units.COMMON.items() for f in sorted(set(us.values())))
    return _claims_sql() + f""", n(q, u, f) AS (VALUES {names}), x AS (SELECT c.quantity, coalesce(lower(trim(claim.unit)), '') AS spelling, c.value, ln(c.value * c.f) AS ln FROM c JOIN claim USING (claim_id) WHERE c.value * c.f > 0 AND c.value > 0),
md AS (SELECT quantity, ln(exp(quantile_disc(ln, 0.5))) AS median FROM x GROUP BY 1), r AS (SELECT x.quantity, spelling, u, quantile_disc(abs(ln(value) - median + ln(f)), 0.5) AS r FROM x JOIN md USING (quantity) JOIN n ON n.q = quantity GROUP BY ALL),
t AS (SELECT quantity, spelling, list(struct_pack(r := r, u := u) ORDER BY r, u) AS a FROM r GROUP BY ALL)
SELECT quantity, spelling, a[1].u AS unit, round(a[1].r, 4) AS residual, coalesce(a[2].r - a[1].r > 0.5, true) AS "unique" FROM t"""


def _plans() -> list:
    return [import_module(f"tarnwell.plans.{p}") for p in PLANS]


def queries() -> dict:
    return {name: f for plan in _plans() for name, f in plan.Q.items()} | {"p6_found": p6_found, "p6_common": p6_common, "p6_units": p6_units}


def oracle_sql() -> dict:
    return {name: sql for plan in _plans() for name, sql in plan.SQL.items()} | {"p6_found": _p6_sql(), "p6_common": _p6_common_sql(), "p6_units": _p6_units_sql()}
