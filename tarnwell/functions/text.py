"""Scalar text functions as columns: everything here stays inside the JVM.

Patterns avoid look-around and dialect-dependent classes, so that other engines give the same values.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TOKEN = r"[a-z0-9]+(?:\.[a-z0-9]+)?|[<>]=?"
#: terms of the lexical index: runs that start and end with a letter or digit
TERM = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_./<>-]*[\p{L}\p{N}_])?"
#: a small default list; every function that needs stop words takes its own
STOPWORDS = (
    "the and for with from that this are was were has have had not but what which who how when where why can does did "
    "will would should could may might must its their there than then them they you your our into over under about after "
    "before between during each any all some such only also more most other those these been being because while if per"
).split()
SPELLED = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11,
    "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19,
    "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
}
#: letters and digits beyond ASCII, which word boundaries of other engines take for none
BEYOND = r"[^\x00-\x7F\p{P}\p{Z}\p{S}]"
UNITS = r"mL/min/1\.73 m²|mg/mmol|mmol/L|µmol/L|mg/g|mmHg|g/L|ng/mL|mg|%|weeks|months|years|days"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, where the plan would repeat a dear expression."""
    return F.transform(F.array(value), body)[0]


def squeeze(t: Column) -> Column:
    """White space of any kind as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(t, r"[\s\x{00a0}]+", " "))


def page_normalize(t: Column) -> Column:
    """NUL and no-break space to blank; words cut before lower-case letters joined; blanks collapsed;
    three or more line feeds to two; trimmed."""
    t = F.translate(t, "\u0000 ", "  ")
    t = F.regexp_replace(t, r"-\n([a-z])", "$1")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def chunk_normalize(t: Column, symbols: dict[str, str]) -> Column:
    """Symbols replaced, units rejoined (``m 2`` to ``m2``), white space squeezed."""
    for a, b in symbols.items():
        t = F.replace(t, F.lit(a), F.lit(b))
    return squeeze(F.regexp_replace(t, r"\bm 2\b", "m2"))


def mirror_repair(t: Column, common: list[str], least: int = 12) -> Column:
    """Text read backwards is turned round if that shows more of the common words; a tie keeps it."""

    def score(x: Column) -> Column:
        return F.size(F.filter(F.regexp_extract_all(F.lower(x), F.lit("[a-z]{3,}"), F.lit(0)), lambda w: w.isin(common)))

    return F.when((F.length(t) >= least) & (score(F.reverse(t)) > score(t)), F.reverse(t)).otherwise(t)


def tokens(t: Column) -> Column:
    return F.regexp_extract_all(F.lower(t), F.lit(TOKEN), F.lit(0))


def terms(t: Column) -> Column:
    return F.regexp_extract_all(F.lower(t), F.lit(TERM), F.lit(0))


def content_terms(t: Column, stopwords: list[str] = STOPWORDS) -> Column:
    return F.array_sort(F.array_distinct(F.filter(tokens(t), lambda w: (F.length(w) > 2) & ~w.isin(stopwords))))


def fingerprint(t: Column, length: int | None = None) -> Column:
    f = F.regexp_replace(F.lower(t), "[^a-z0-9]", "")
    return F.substring(f, 1, length) if length else f


def slug(t: Column, length: int = 60, fallback: str = "chunk") -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(t), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(F.length(s) > 0, F.substring(s, 1, length)).otherwise(fallback)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets: 1 for two empty ones, 0 for one."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix, by halving: sixteen substring comparisons, whatever the length."""
    n = F.least(F.length(a), F.length(b))
    steps = F.array(*[F.lit(1 << k) for k in range(15, -1, -1)])

    def grow(k: Column, step: Column) -> Column:
        longer = (k + step <= n) & (F.substring(a, F.lit(1), k + step) == F.substring(b, F.lit(1), k + step))
        return F.when(longer, k + step).otherwise(k)

    return F.aggregate(steps, F.lit(0), grow)


def tags(t: Column, lexicon: dict[str, str], fallback: str) -> Column:
    """Names of the patterns that the lower-case text matches, in the lexicon's order."""
    low = F.lower(t)
    found = F.filter(F.array(*[F.when(low.rlike(p), F.lit(n)) for n, p in lexicon.items()]), lambda x: x.isNotNull())
    return F.when(F.size(found) == 0, F.array(F.lit(fallback))).otherwise(found)


def numeric_share(t: Column) -> Column:
    w = tokens(t)
    return let(w, lambda x: F.when(F.size(x) == 0, 0.0).otherwise(F.size(F.filter(x, lambda y: y.rlike("^[0-9]"))) / F.size(x)))


def heading_level(line: Column) -> Column:
    return (
        F.when(line.rlike(r"^(Chapter|Appendix)\b"), 0).when(line.rlike(r"^\d+\.\d+\.\d+"), 2).when(line.rlike(r"^\d+\.\d+"), 1)
        .when((F.upper(line) == line) & (F.length(line) > 8), 0).otherwise(2)
    )


def numbers(t: Column) -> Column:
    return F.transform(F.regexp_extract_all(t, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0)), lambda x: x.cast("double"))


def plain_number(v: Column) -> Column:
    """A double in its shortest decimal form, without an exponent or trailing zeros: ``5.5``, ``60``."""
    exact = v.try_cast("decimal(38,15)")
    return F.when(v == 0, "0").when(exact == v, F.regexp_replace(exact.cast("string"), r"\.?0+$", "")).otherwise(v.cast("string"))


def spelled_numbers(t: Column) -> Column:
    """Values of spelled numbers such as ``sixty-five`` or ``eleven``, in order."""
    tens, ones = [w for w, v in SPELLED.items() if v >= 20], [w for w, v in SPELLED.items() if v < 20]
    digits = [w for w in ones if 0 < SPELLED[w] < 10]
    pattern = rf"\b(?:(?:{'|'.join(tens)})(?:[ -](?:{'|'.join(digits)}))?|{'|'.join(sorted(ones, key=len, reverse=True))})\b"
    value = F.create_map(*[F.lit(x) for pair in SPELLED.items() for x in pair])
    return F.transform(
        F.regexp_extract_all(F.regexp_replace(F.lower(t), BEYOND, "_"), F.lit(pattern), F.lit(0)),
        lambda m: F.aggregate(F.split(m, "[ -]"), F.lit(0), lambda a, w: a + value[w]).cast("double"),
    )


def stated_values(t: Column, units: str = UNITS) -> Column:
    """Distinct value-unit pairs without blanks, in lower case, sorted."""
    found = F.regexp_extract_all(t, F.lit(rf"[0-9]+(?:\.[0-9]+)? ?(?:{units})"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.lower(F.replace(x, F.lit(" "), F.lit(""))))))


def query_key(t: Column) -> Column:
    return F.substring(F.sha1(F.lower(squeeze(t))), 1, 16)


def snippet(t: Column, length: int = 240) -> Column:
    return F.substring(squeeze(t), 1, length)


def line_count(t: Column) -> Column:
    return F.size(F.filter(F.split(t, "\n"), lambda x: F.length(F.trim(x)) > 0))


def word_count(t: Column) -> Column:
    return F.size(F.regexp_extract_all(t, F.lit(r"[^ \t\n\r\f\x0b]+"), F.lit(0)))
