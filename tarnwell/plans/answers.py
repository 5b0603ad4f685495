"""Gates in order, composed answers, analysis of claims, encoders and rules of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tarnwell.functions import lexicon as L, text as T
from tarnwell.operators import encoders, search as path
from tarnwell.plans import evaluation as E, retrieval as R
from tarnwell.plans.text import SQUEEZE, quoted
from tarnwell.sources import table

Q: dict = {}
SQL: dict[str, str] = {}
PACK = "pregnancy_scope_evidence_pack"
#: a best score below this gives no answer
CONFIDENT = 0.35


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def first_match(low: Column, rules: dict[str, str]) -> Column:
    """The first rule, in order, whose pattern a lower-case text matches; null for none."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(list(rules.items())):
        out = F.when(low.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def _first_sql(text: str, rules: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{p}') THEN '{n}'" for n, p in rules.items()) + " END"


def refusal(low: Column) -> Column:
    """The first refused category; the emergency rule alone is lifted where the emergency is over."""
    rest = {n: p for n, p in L.REFUSED.items() if n != "emergency"}
    return F.when(low.rlike(L.POST_ACUTE), first_match(low, rest)).otherwise(first_match(low, L.REFUSED))


_REFUSED = f"CASE WHEN regexp_matches(lower(query), '{L.POST_ACUTE}') THEN {_first_sql('lower(query)', {n: p for n, p in L.REFUSED.items() if n != 'emergency'})} ELSE {_first_sql('lower(query)', L.REFUSED)} END"


@query(f"""SELECT case_key, {_REFUSED} AS refused, regexp_matches(lower(query), '{L.POST_ACUTE}') AS post_acute, regexp_matches(lower(query), '{L.SPECIALTIES}') AND NOT regexp_matches(lower(query), '{L.DOMAIN}') AS other_specialty
FROM (SELECT case_key, query FROM ckd_gold_eval UNION ALL SELECT case_key, query FROM heldout_chunkfirst) WHERE query IS NOT NULL""")
def refusals(spark, d):
    own = ["case_key", "query"]
    q = table(spark, d, "ckd_gold_eval", *own).unionByName(table(spark, d, "heldout_chunkfirst", *own)).where("query is not null")
    low = F.lower("query")
    return q.select("case_key", refusal(low).alias("refused"), low.rlike(L.POST_ACUTE).alias("post_acute"), (low.rlike(L.SPECIALTIES) & ~low.rlike(L.DOMAIN)).alias("other_specialty"))


_UNIT = T.UNITS
_BANDED = rf"([0-9]+(?:\.[0-9]+)?) ?(?:-|–|to|and) ?([0-9]+(?:\.[0-9]+)?) ?({_UNIT})"
_VALUED = rf"([0-9]+(?:\.[0-9]+)?) ?({_UNIT})"


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def premise(query: Column, texts: Column) -> Column:
    """Whether each value with a unit that a query states is stated by one of the texts or lies in a closed
    band of the same unit; true for a query without values."""
    values = F.arrays_zip(_all(query, _VALUED, 1).alias("v"), _all(query, _VALUED, 2).alias("u"))
    said = F.array_join(texts, "\n")
    stated = F.arrays_zip(_all(said, _VALUED, 1).alias("v"), _all(said, _VALUED, 2).alias("u"))
    bands = F.arrays_zip(_all(said, _BANDED, 1).alias("lo"), _all(said, _BANDED, 2).alias("hi"), _all(said, _BANDED, 3).alias("u"))

    def held(x: Column) -> Column:
        v = x["v"].cast("double")
        same = F.exists(stated, lambda s: (s["v"].cast("double") == v) & (s["u"] == x["u"]))
        inside = F.exists(bands, lambda b: (b["u"] == x["u"]) & (b["lo"].cast("double") <= v) & (v <= b["hi"].cast("double")))
        return same | inside

    return F.forall(values, held)


def _pairs_sql(text: str, pattern: str, fields: list[str]) -> str:
    groups = ", ".join(f"{f} := regexp_extract_all({text}, '{pattern}', {k + 1})[i]" for k, f in enumerate(fields))
    return f"list_transform(range(1, len(regexp_extract_all({text}, '{pattern}', 1)) + 1), lambda i: struct_pack({groups}))"


_STATUS = f"""{R.HYBRID}, shown AS (SELECT qid, rank, hybrid.score, sample_id, id, text, chunk_type FROM hybrid JOIN chunks USING (sample_id)),
five AS (SELECT qid, max(score) AS best, count(*) FILTER (chunk_type IN ({quoted(L.QUOTABLE)})) AS quotable, string_agg(text, chr(10) ORDER BY rank) FILTER (rank <= 5 AND chunk_type IN ({quoted(L.QUOTABLE)})) AS said FROM shown GROUP BY qid),
pq AS (SELECT qid, query, coalesce(best, 0) AS best, coalesce(quotable, 0) AS quotable, {_pairs_sql('query', _VALUED, ['v', 'u'])} AS vs, {_pairs_sql("coalesce(said, '')", _VALUED, ['v', 'u'])} AS stated, {_pairs_sql("coalesce(said, '')", _BANDED, ['lo', 'hi', 'u'])} AS bands FROM asked LEFT JOIN five USING (qid)),
pr AS (SELECT *, len(list_filter(vs, lambda x: len(list_filter(stated, lambda s: s.v::DOUBLE = x.v::DOUBLE AND s.u = x.u)) = 0 AND len(list_filter(bands, lambda b: b.u = x.u AND b.lo::DOUBLE <= x.v::DOUBLE AND x.v::DOUBLE <= b.hi::DOUBLE)) = 0)) = 0 AS premise FROM pq),
status AS (SELECT qid, query, round(best, 6) AS best, CASE WHEN len(list_filter({R._CONTENT.format('query')}, lambda w: NOT regexp_matches(w, '^[0-9.]+$'))) = 0 THEN 'no_question'
 WHEN {_first_sql('lower(query)', L.GENRES)} IS NOT NULL THEN 'genre' WHEN ({_REFUSED}) IS NOT NULL THEN 'refused'
 WHEN NOT regexp_matches(lower(query), '{L.DOMAIN}') THEN 'out_of_domain' WHEN NOT premise THEN 'premise_unsupported' WHEN quotable = 0 OR best < {CONFIDENT} THEN 'insufficient_evidence' ELSE 'answered' END AS status FROM pr)"""


def _shown(spark, d) -> DataFrame:
    """The whole run's results with their texts."""
    return R.run(spark, d, whole=True).join(R.chunks(spark, d).select("sample_id", "id", "text", "chunk_type"), "sample_id")


def statuses(spark, d) -> DataFrame:
    """(qid, query, best, status): the gates in their order, the first that closes gives the status."""
    quotable = F.col("chunk_type").isin(*L.QUOTABLE)
    top = _shown(spark, d).groupBy("qid").agg(
        F.max("score").alias("best"), F.count_if(quotable).alias("quotable"),
        F.array_sort(F.collect_list(F.when(quotable & (F.col("rank") <= 5), F.struct("rank", "text")))).alias("five"),  # ten rows a query
    )
    q = R.asked(spark, d, True).select("qid", "query").join(top, "qid", "left")
    low = F.lower("query")
    texts = F.coalesce(F.transform("five", lambda x: x["text"]), F.array().cast("array<string>"))
    best, n = F.coalesce("best", F.lit(0.0)), F.coalesce("quotable", F.lit(0))
    status = (
        F.when(~F.exists(T.content_terms(F.col("query")), lambda w: ~w.rlike("^[0-9.]+$")), "no_question")
        .when(first_match(low, L.GENRES).isNotNull(), "genre").when(refusal(low).isNotNull(), "refused")
        .when(~low.rlike(L.DOMAIN), "out_of_domain").when(~premise(F.col("query"), texts), "premise_unsupported")
        .when((n == 0) | (best < CONFIDENT), "insufficient_evidence").otherwise("answered")
    )
    return q.select("qid", "query", F.round(best, 6).alias("best"), status.alias("status"))


@query(R.whole(f"WITH {_STATUS} SELECT qid, best, status FROM status"))
def gate_order(spark, d):
    """Askable, genre, refusals, domain, premise, confidence: which gate closes first for each question."""
    return statuses(spark, d).select("qid", "best", "status")


_QUOTES = f"""{_STATUS}, qt AS (SELECT qid, rank, id, {SQUEEZE.format('text')} AS t, substr(regexp_replace(lower(text), '[^a-z0-9]', '', 'g'), 1, 120) AS fp FROM shown WHERE chunk_type IN ({quoted(L.QUOTABLE)})),
qd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, fp ORDER BY rank) AS k FROM qt) WHERE k = 1), qn AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS n FROM qd),
qa AS (SELECT qid, string_agg('[' || n || '] ' || substr(t, 1, 240) || ' (' || id || ')', chr(10) ORDER BY n) AS quotes, count(*) AS n_quotes FROM qn WHERE n <= 3 GROUP BY qid)"""


@query(R.whole(f"WITH {_QUOTES} SELECT qid, status, CASE WHEN status = 'answered' THEN quotes ELSE 'No answer: ' || replace(status, '_', ' ') END AS answer, CAST(CASE WHEN status = 'answered' THEN n_quotes ELSE 0 END AS BIGINT) AS n_quotes FROM status LEFT JOIN qa USING (qid)"))
def build_answer(spark, d):
    """The composition: gates, then up to three different quotes of quotable chunks, each with its source."""
    q = _shown(spark, d).where(F.col("chunk_type").isin(*L.QUOTABLE)).select("qid", "rank", "id", T.snippet(F.col("text")).alias("t"), T.fingerprint(F.col("text"), 120).alias("fp"))
    once = q.groupBy("qid", "fp").agg(F.min(F.struct("rank", "id", "t")).alias("x")).select("qid", "x.*")
    best = once.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).where("n <= 3")
    line = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), "t", F.lit(" ("), "id", F.lit(")"))
    quotes = best.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))).alias("x"))
    a = statuses(spark, d).join(quotes, "qid", "left")
    answered = F.col("status") == "answered"
    text = F.when(answered, F.array_join(F.transform("x", lambda x: x["line"]), "\n")).otherwise(F.concat(F.lit("No answer: "), F.replace("status", F.lit("_"), F.lit(" "))))
    return a.select("qid", "status", text.alias("answer"), F.when(answered, F.size("x")).otherwise(0).cast("bigint").alias("n_quotes"))


@query(f"SELECT query_id, count(*) FILTER (citation IS NOT NULL AND regexp_extract(id, '_p[0-9]+_([a-z]+_[a-z]+)_', 1) IN ({quoted(L.QUOTABLE)})) AS quotable, count(*) AS n FROM {PACK} GROUP BY query_id")
def quotable(spark, d):
    """How much of each pack may be quoted: cited, and of a kind that says something by itself."""
    kind = F.regexp_extract("id", "_p[0-9]+_([a-z]+_[a-z]+)_", 1)
    return table(spark, d, PACK, "query_id", "id", "citation").groupBy("query_id").agg(F.count_if(F.col("citation").isNotNull() & kind.isin(*L.QUOTABLE)).alias("quotable"), F.count("*").alias("n"))


_CONFIG = path.Config()


@query("SELECT * FROM (VALUES " + ", ".join(f"('{s}', {w}::DOUBLE, {'true' if s in _CONFIG.scaled else 'false'})" for s, w in _CONFIG.weights.items()) + ") AS x(signal, weight, scaled)")
def search_weights(spark, d):
    """The search's signals as they are configured."""
    return spark.createDataFrame([(s, float(w), s in _CONFIG.scaled) for s, w in _CONFIG.weights.items()], "signal string, weight double, scaled boolean")


# Claims


_SIDES = """b AS (SELECT claim_id, quantity, unit, population, document_id, value, value_high, lower(comparator) AS c, CASE WHEN lower(comparator) IN ('<', '<=', '≤', 'less than', 'lower than', 'below', 'under') THEN CAST(0 AS DOUBLE) ELSE value END AS low,
 CASE WHEN lower(comparator) IN ('>', '>=', '≥', 'greater than', 'more than', 'above', 'over', 'at least') THEN CAST('Infinity' AS DOUBLE) WHEN lower(comparator) = 'between' THEN value_high ELSE value END AS high FROM claim WHERE value IS NOT NULL AND comparator IS NOT NULL),
h AS (SELECT quantity, unit, population, document_id, min((isinf(high)::INT, claim_id))[2] AS claim_id, max(low) AS ml, min(high) AS mh FROM b GROUP BY ALL),
g AS (SELECT h.quantity, h.unit, h.population, count(*) AS documents, max(ml) AS ml, min(mh) AS mh, count(DISTINCT (b.c, b.value)) AS heads FROM h JOIN b USING (claim_id) GROUP BY h.quantity, h.unit, h.population HAVING count(*) >= 2),
s AS (SELECT quantity, unit, population, documents, heads, CASE WHEN ml > mh THEN 'incompatible' WHEN heads > 1 THEN 'differs' ELSE 'agree' END AS status FROM g)"""


def compared(spark, d) -> DataFrame:
    """Groups of claims of at least two documents: incompatible bounds, else different headline claims, else agreement."""
    b = E._bounds(spark, d).withColumn("c", F.lower("comparator"))
    open_ = F.coalesce((F.col("high") == float("inf")).cast("int"), F.lit(None))
    h = b.groupBy("quantity", "unit", "population", "document_id").agg(F.min(F.when(open_.isNotNull(), F.struct(open_.alias("o"), "claim_id", "c", "value"))).alias("m"), F.min(F.struct("claim_id", "c", "value")).alias("any"), F.max("low").alias("ml"), F.min("high").alias("mh"))
    head = F.coalesce(F.struct(F.col("m.c").alias("c"), F.col("m.value").alias("v")), F.struct(F.col("any.c").alias("c"), F.col("any.value").alias("v")))
    g = h.groupBy("quantity", "unit", "population").agg(F.count("*").alias("documents"), F.max("ml").alias("ml"), F.min("mh").alias("mh"), F.count_distinct(head).alias("heads")).where("documents >= 2")
    return g.withColumn("status", F.when(F.col("ml") > F.col("mh"), "incompatible").when(F.col("heads") > 1, "differs").otherwise("agree"))


@query(f"WITH {_SIDES} SELECT quantity, unit, population, documents, status FROM s")
def headline_agreement(spark, d):
    return compared(spark, d).select("quantity", "unit", "population", "documents", "status")


@query(f"""WITH {_SIDES} SELECT quantity, count(*) AS compared, count(*) FILTER (status <> 'agree') AS divergent, quantity || ': ' || count(*) FILTER (status = 'incompatible') || ' incompatible, ' || count(*) FILTER (status = 'differs') || ' different, ' || count(*) FILTER (status = 'agree') || ' alike' AS summary FROM s GROUP BY quantity""")
def analysis_summary(spark, d):
    """What the comparison of claims says of each quantity."""
    n = {s: F.count_if(F.col("status") == s) for s in ("incompatible", "differs", "agree")}
    g = compared(spark, d).groupBy("quantity").agg(F.count("*").alias("compared"), *[x.alias(s) for s, x in n.items()])
    text = F.concat("quantity", F.lit(": "), F.col("incompatible").cast("string"), F.lit(" incompatible, "), F.col("differs").cast("string"), F.lit(" different, "), F.col("agree").cast("string"), F.lit(" alike"))
    return g.select("quantity", "compared", (F.col("incompatible") + F.col("differs")).alias("divergent"), text.alias("summary"))


# Encoders


@query(f"WITH {R.CHUNKS}, {R._hashed_sql('dv', 'chunks', 'sample_id', 'text')} SELECT sample_id, CAST(dim AS INT) AS dim, round(x, 6) AS x FROM dv WHERE abs(x) > 1e-12")
def encoded_chunks(spark, d):
    """Vectors of the registered stand-in encoder, their entries as rows."""
    docs = R.chunks(spark, d)
    v = encoders.encode(docs, "sample_id", "text")
    return v.select("sample_id", F.posexplode("v").alias("dim", "x")).where("abs(x) > 1e-12").select("sample_id", "dim", F.round("x", 6).alias("x"))


def _signed_sql(name: str, source: str, key: str, text: str) -> str:
    return f"""{name} AS (SELECT DISTINCT {key}, ('0x' || substr(md5(t), 1, 2))::INT % 64 AS dim, CASE WHEN substr(md5(t), 3, 1) < '8' THEN 1 ELSE -1 END AS sign, t FROM (SELECT {key}, unnest({R._TERMS.format(text)}) AS t FROM {source}))"""


@query(f"""WITH {R.SEARCH}, {R.POOL}, {_signed_sql('qs', 'asked', 'qid', 'query')}, {_signed_sql('ds', 'chunks', 'sample_id', 'text')}, dd AS (SELECT DISTINCT sample_id, dim, sign FROM ds),
p AS (SELECT pool.qid, pool.sample_id, qs.t, max(CASE WHEN dd.dim <> qs.dim THEN 0 ELSE qs.sign * dd.sign END) AS best FROM pool JOIN qs ON qs.qid = pool.qid JOIN dd ON dd.sample_id = pool.sample_id GROUP BY ALL)
SELECT qid, sample_id, CAST(sum(best) AS BIGINT) AS score FROM p GROUP BY ALL""")
def late_interaction(spark, d):
    """The pool by late interaction of the stand-in's term vectors: of each distinct query term the best dot product
    with any term of the chunk, summed.  Term vectors have one entry, so a term's best is 1 if the chunk has
    the entry, else 0 unless all its entries are the opposite one."""
    def entries(terms: Column) -> Column:
        h = lambda t: F.md5(t)
        return F.transform(terms, lambda t: (F.conv(F.substring(h(t), 1, 2), 16, 10).cast("int") % 64 + 1) * F.when(F.substring(h(t), 3, 1) < "8", 1).otherwise(-1))

    p = R._pool(spark, d).select("qid", "sample_id").join(R.asked(spark, d).select("qid", entries(F.array_distinct(T.terms(F.col("query")))).alias("q")), "qid")
    p = p.join(R.chunks(spark, d).select("sample_id", F.array_distinct(entries(T.terms(F.col("text")))).alias("t")), "sample_id").where("size(q) > 0 and size(t) > 0")
    one = lambda x: F.when(F.array_contains("t", x), 1).when((F.size("t") == 1) & (F.col("t")[0] == -x), -1).otherwise(0)
    return p.select("qid", "sample_id", F.aggregate(F.transform("q", one), F.lit(0), lambda a, x: a + x).cast("bigint").alias("score"))


# Rules of chunks and cells


@query("SELECT row_id, md5(regexp_replace(coalesce(pdfplumber_text, ''), '\\n', ' ', 'g')) AS cell FROM page_record")
def clean_cells(spark, d):
    """Cells in one line; missing ones are empty."""
    return table(spark, d, "page_record", "row_id", "pdfplumber_text").select("row_id", F.md5(F.regexp_replace(F.coalesce("pdfplumber_text", F.lit("")), "\n", " ")).alias("cell"))


_NUMBERED = r"^[0-9]+(?:\.[0-9]+)+ "


@query(f"""WITH l AS (SELECT row_id, unnest(string_split(text, chr(10))) AS line FROM page_record WHERE text IS NOT NULL)
SELECT row_id, count(*) FILTER (regexp_matches(line, '{_NUMBERED}Rationale')) AS rationale, count(*) FILTER (NOT regexp_matches(line, '{_NUMBERED}Rationale')) AS other FROM l WHERE regexp_matches(line, '{_NUMBERED}') GROUP BY row_id""")
def rationale_headings(spark, d):
    """Numbered headings of rationales, which are no recommendations however they are numbered."""
    l = table(spark, d, "page_record", "row_id", "text").where("text is not null").select("row_id", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(_NUMBERED))  # noqa: E741
    why = F.col("line").rlike(_NUMBERED + "Rationale")
    return l.groupBy("row_id").agg(F.count_if(why).alias("rationale"), F.count_if(~why).alias("other"))


_ITEM = r"(?:Practice Point|Recommendation) [0-9]+\.[0-9]+\.[0-9]+"
_READ = ["text", "pymupdf_text", "pdfplumber_text"]


@query(f"""WITH c AS (SELECT row_id, [{", ".join(f"len(regexp_extract_all(coalesce({c}, ''), '{_ITEM}', 0))" for c in _READ)}] AS n FROM page_record)
SELECT row_id, [{quoted(_READ)}][list_position(n, list_max(n))] AS best, CAST(list_max(n) AS INT) AS items FROM c""")
def best_reading(spark, d):
    """Of the readings of a page the one with the most numbered items; the first on a tie."""
    n = F.array(*[F.size(_all(F.coalesce(c, F.lit("")), _ITEM, 0)) for c in _READ])
    p = table(spark, d, "page_record", "row_id", *_READ).select("row_id", n.alias("n"))
    return p.select("row_id", F.array(*map(F.lit, _READ))[F.array_position("n", F.array_max("n")).cast("int") - 1].alias("best"), F.array_max("n").alias("items"))


_LABEL = r"^(?:Practice Point|Recommendation) [0-9.]+:?\s*"
_BOOK = r"\b(?:isbn|issn|printed|page|volume|copyright)\b"


@query(f"""WITH f AS (SELECT sample_id, array_to_string(list_filter([CASE WHEN regexp_matches(lower(trim(text)), '^fig(?:ure)?\\.? ?[0-9]') AND chunk_type = 'table_row' THEN 'figure_data' END,
 CASE WHEN chunk_type IN ('recommendation_atom', 'practice_point') AND length(trim(regexp_replace(text, '{_LABEL}', ''))) < 40 THEN 'stub_recommendation' END, CASE WHEN regexp_matches(text, '\\.{{4,}}') THEN 'dot_leaders' END,
 CASE WHEN regexp_matches(lower(text), '{_BOOK}') THEN 'bookkeeping' END, CASE WHEN len(regexp_extract_all(text, '\\b[A-Z]{{2,8}}[,;]? [a-z]', 0)) >= 3 AND length(text) < 400 THEN 'acronyms' END], lambda x: x IS NOT NULL), ',') AS flags FROM question_sample2 WHERE text IS NOT NULL)
SELECT * FROM f WHERE flags <> ''""")
def chunk_rules(spark, d):
    """Rules that tell figures' data, stubs, contents, bookkeeping and lists of abbreviations from text."""
    t, kind = F.col("text"), F.col("chunk_type")
    flags = F.array(
        F.when(F.lower(F.trim(t)).rlike(r"^fig(?:ure)?\.? ?[0-9]") & (kind == "table_row"), "figure_data"),
        F.when(kind.isin("recommendation_atom", "practice_point") & (F.length(F.trim(F.regexp_replace(t, _LABEL, ""))) < 40), "stub_recommendation"),
        F.when(t.rlike(r"\.{4,}"), "dot_leaders"), F.when(F.lower(t).rlike(_BOOK), "bookkeeping"),
        F.when((F.size(_all(t, r"\b[A-Z]{2,8}[,;]? [a-z]", 0)) >= 3) & (F.length(t) < 400), "acronyms"),
    )
    q = table(spark, d, "question_sample2").where("text is not null").select("sample_id", F.array_join(F.filter(flags, lambda x: x.isNotNull()), ",").alias("flags"))
    return q.where("flags <> ''")
