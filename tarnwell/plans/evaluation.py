"""Queries of gates, answers, claims, verification, evaluation and experiments."""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tarnwell.functions import lexicon as L, text as T
from tarnwell.operators import blocks, metrics, search as path
from tarnwell.plans import retrieval as R
from tarnwell.plans.text import SQUEEZE
from tarnwell.sources import table
from tarnwell.sources.store import stored

Q: dict = {}
SQL: dict[str, str] = {}
PACK = "pregnancy_scope_evidence_pack"


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def gold(spark, d):
    return table(spark, d, "ckd_gold_eval").where("query is not null")


_CONTENT = R._CONTENT


@query(f"SELECT case_key, len(list_filter({_CONTENT.format('query')}, lambda w: NOT regexp_matches(w, '^[0-9.]+$'))) > 0 AS askable FROM ckd_gold_eval WHERE query IS NOT NULL")
def askable(spark, d):
    return gold(spark, d).select("case_key", F.exists(T.content_terms(F.col("query")), lambda w: ~w.rlike("^[0-9.]+$")).alias("askable"))


@query("SELECT case_key, CASE " + " ".join(f"WHEN regexp_matches(lower(query), '{p}') THEN '{n}'" for n, p in L.GENRES.items()) + " ELSE 'question' END AS genre FROM ckd_gold_eval WHERE query IS NOT NULL")
def question_genre(spark, d):
    low, c = F.lower("query"), F.lit("question")
    for n, p in reversed(list(L.GENRES.items())):
        c = F.when(low.rlike(p), n).otherwise(c)
    return gold(spark, d).select("case_key", c.alias("genre"))


_SCOPED = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(query), '{p}') THEN '{n}' END" for n, p in L.SCOPES.items()) + "], lambda x: x IS NOT NULL)"


@query(f"SELECT case_key, len({_SCOPED}) > 0 AS scoped, array_to_string({_SCOPED}, ',') AS matched, regexp_matches(lower(query), '{L.DOMAIN}') AS in_domain FROM ckd_gold_eval WHERE query IS NOT NULL")
def scope_gate(spark, d):
    low = F.lower("query")
    found = F.filter(F.array(*[F.when(low.rlike(p), F.lit(n)) for n, p in L.SCOPES.items()]), lambda x: x.isNotNull())
    return gold(spark, d).select("case_key", (F.size(found) > 0).alias("scoped"), F.array_join(found, ",").alias("matched"), low.rlike(L.DOMAIN).alias("in_domain"))


@query(f"""WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{{5,}}', 0)) AS w FROM question_sample2),
q AS (SELECT DISTINCT case_key, unnest(regexp_extract_all(lower(query), '[a-z]{{5,}}', 0)) AS w FROM ckd_gold_eval)
SELECT case_key, array_to_string(list_sort(list(w)), ' ') AS unknown FROM q ANTI JOIN v USING (w) GROUP BY case_key""")
def unknown_concepts(spark, d):
    def words(c):
        return F.explode(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{5,}"), F.lit(0))).alias("w")

    v = table(spark, d, "question_sample2").select(words("text")).distinct()
    q = table(spark, d, "ckd_gold_eval").select("case_key", words("query")).distinct()
    return q.join(v, "w", "left_anti").groupBy("case_key").agg(F.array_join(F.array_sort(F.collect_list("w")), " ").alias("unknown"))  # words of one query


@query("""WITH p AS (SELECT claim_id, chunk_id, quantity, value FROM claim WHERE value IS NOT NULL AND comparator = '='), b AS (SELECT DISTINCT quantity, document_id, value AS lo, value_high AS hi FROM claim WHERE value_high IS NOT NULL AND value IS NOT NULL)
SELECT claim_id FROM p WHERE EXISTS (SELECT 1 FROM b JOIN claim c ON c.claim_id = p.claim_id AND c.document_id = b.document_id WHERE b.quantity = p.quantity AND p.value BETWEEN b.lo AND b.hi)""")
def premise_supported(spark, d):
    """Claims of a single value that lie in a closed band which the same document states."""
    c = table(spark, d, "claim", "claim_id", "quantity", "document_id", "comparator", "value", "value_high").where("value is not null")
    b = c.where("value_high is not null").select("quantity", "document_id", F.col("value").alias("lo"), F.col("value_high").alias("hi")).distinct()
    p = c.where("comparator = '='")
    on = [p.quantity == b.quantity, p.document_id == b.document_id, p.value.between(b.lo, b.hi)]
    return p.join(b, on, "left_semi").select("claim_id")


@query(f"""WITH t AS (SELECT query_id, max(score) AS best, count(*) AS n, any_value(query) AS query FROM {PACK} GROUP BY query_id)
SELECT query_id, CASE WHEN len({_CONTENT.format('query')}) = 0 THEN 'no_question' WHEN NOT regexp_matches(lower(query), '{L.DOMAIN}') THEN 'out_of_domain' WHEN n < 2 THEN 'insufficient_evidence' ELSE 'answered' END AS status FROM t""")
def answer_status(spark, d):
    t = table(spark, d, PACK).groupBy("query_id").agg(F.count("*").alias("n"), F.min("query").alias("query"))
    status = F.when(F.size(T.content_terms(F.col("query"))) == 0, "no_question").when(~F.lower("query").rlike(L.DOMAIN), "out_of_domain").when(F.col("n") < 2, "insufficient_evidence").otherwise("answered")
    return t.select("query_id", status.alias("status"))


SQL["answer_status"] = SQL["answer_status"].replace("any_value(query)", "min(query)")


@query(f"""WITH r AS (SELECT query_id, id, rank, document_id, unnest(list_distinct(regexp_extract_all(raw_text, 'eGFR|ferritin|haemoglobin', 0))) AS ref FROM {PACK}), t AS (SELECT DISTINCT document_id, quantity, chunk_id FROM claim),
k AS (SELECT query_id, id, ref, chunk_id, row_number() OVER (PARTITION BY query_id, id, ref ORDER BY chunk_id) AS sub FROM r JOIN t USING (document_id) WHERE lower(ref) = quantity)
SELECT query_id, id, ref, chunk_id, CAST(sub AS INT) AS sub FROM k WHERE sub <= 2""")
def resolve_refs(spark, d):
    e = table(spark, d, PACK, "query_id", "id", "document_id", "raw_text")
    r = e.select("query_id", "id", "document_id", F.explode(F.array_distinct(F.regexp_extract_all("raw_text", F.lit("eGFR|ferritin|haemoglobin"), F.lit(0)))).alias("ref"))
    t = table(spark, d, "claim", "document_id", "quantity", "chunk_id").distinct()
    j = r.join(t, (r.document_id == t.document_id) & (F.lower("ref") == t.quantity))
    w = Window.partitionBy("query_id", "id", "ref").orderBy("chunk_id")
    return j.withColumn("sub", F.row_number().over(w)).where("sub <= 2").select("query_id", "id", "ref", "chunk_id", "sub")


@query("""WITH b AS (SELECT o_orderkey, o_totalprice FROM orders), r AS (SELECT r_regionkey * 80000.0 AS lo, r_regionkey * 80000.0 + 120000 AS hi, r_regionkey AS pos FROM region),
k AS (SELECT o_orderkey, pos, row_number() OVER (PARTITION BY o_orderkey ORDER BY hi - lo, pos) AS rn FROM b JOIN r ON o_totalprice BETWEEN lo AND hi) SELECT o_orderkey, pos FROM k WHERE rn = 1""")
def band_lookup(spark, d):
    """Narrowest band that contains a value; the bands are five rows that don't grow."""
    lo = F.col("r_regionkey") * 80000.0
    r = table(spark, d, "region").select(lo.alias("lo"), (lo + 120000).alias("hi"), F.col("r_regionkey").alias("pos"))
    b = table(spark, d, "orders", "o_orderkey", "o_totalprice")
    j = b.join(F.broadcast(r), F.col("o_totalprice").between(F.col("lo"), F.col("hi")))
    return j.groupBy("o_orderkey").agg(F.min(F.struct((F.col("hi") - F.col("lo")).alias("width"), "pos")).alias("m")).select("o_orderkey", "m.pos")


@query("""WITH n AS (SELECT document_id, page, row_id, md5(text) AS own, lag(md5(text)) OVER w AS before, lead(md5(text)) OVER w AS after, lag(page) OVER w AS p0, lead(page) OVER w AS p1 FROM page_record WINDOW w AS (PARTITION BY document_id ORDER BY page, row_id))
SELECT row_id, CASE WHEN p0 >= page - 1 THEN before END AS before, CASE WHEN p1 <= page + 1 THEN after END AS after FROM n""")
def neighbour_context(spark, d):
    """The texts before and behind each parse of a page, on the page itself or the next one.  Parses are ordered
    within a page, and pages meet by number, so a document of any size is spread over its pages."""
    n = table(spark, d, "page_record", "document_id", "page", "row_id", "text").withColumn("h", F.md5("text"))
    w = Window.partitionBy("document_id", "page").orderBy("row_id")
    own = n.withColumns({"first": F.row_number().over(w) == 1, "last": F.lead("row_id").over(w).isNull(), "b": F.lag("h").over(w), "a": F.lead("h").over(w)})
    ends = n.groupBy("document_id", "page").agg(F.max_by("h", "row_id").alias("last_h"), F.min_by("h", "row_id").alias("first_h"))
    before = ends.select(F.col("document_id").alias("d0"), (F.col("page") + 1).alias("p0"), F.col("last_h").alias("h0"))
    behind = ends.select(F.col("document_id").alias("d1"), (F.col("page") - 1).alias("p1"), F.col("first_h").alias("h1"))
    j = own.join(before, F.col("document_id").eqNullSafe(F.col("d0")) & (F.col("page") == F.col("p0")), "left").join(behind, F.col("document_id").eqNullSafe(F.col("d1")) & (F.col("page") == F.col("p1")), "left")
    return j.select("row_id", F.when(F.col("first"), F.col("h0")).otherwise(F.col("b")).alias("before"), F.when(F.col("last"), F.col("h1")).otherwise(F.col("a")).alias("after"))


@query(f"""SELECT query_id, string_agg('[' || rank || '] ' || coalesce(citation, 'no source') || ': ' || substr({SQUEEZE.format('raw_text')}, 1, 80), E'\\n' ORDER BY rank, id) AS prompt FROM {PACK} GROUP BY query_id""")
def prompt_builder(spark, d):
    e = table(spark, d, PACK, "query_id", "rank", "id", "citation", "raw_text")
    item = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("citation", F.lit("no source")), F.lit(": "), T.snippet(F.col("raw_text"), 80))
    g = e.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", item.alias("item")))).alias("x"))  # a pack is cut to its ranks
    return g.select("query_id", F.array_join(F.transform("x", lambda s: s["item"]), "\n").alias("prompt"))


# Claims and verification


@query("""SELECT claim_id, CASE WHEN c IN ('<', '<=', '≤', 'less than', 'lower than', 'below', 'under') THEN CAST(0 AS DOUBLE) ELSE value END AS low,
 CASE WHEN c IN ('>', '>=', '≥', 'greater than', 'more than', 'above', 'over', 'at least') THEN CAST('Infinity' AS DOUBLE) WHEN c = 'between' THEN value_high ELSE value END AS high FROM (SELECT *, lower(comparator) AS c FROM claim) WHERE value IS NOT NULL AND c IS NOT NULL""")
def claim_bounds(spark, d):
    return _bounds(spark, d).select("claim_id", "low", "high")


_BELOW, _ABOVE = ["<", "<=", "≤", "less than", "lower than", "below", "under"], [">", ">=", "≥", "greater than", "more than", "above", "over", "at least"]


def _bounds(spark, d):
    c = F.lower("comparator")
    low = F.when(c.isin(*_BELOW), 0.0).otherwise(F.col("value"))
    high = F.when(c.isin(*_ABOVE), float("inf")).when(c == "between", F.col("value_high")).otherwise(F.col("value"))
    return table(spark, d, "claim").where("value is not null and comparator is not null").withColumn("low", low).withColumn("high", high)


@query("""WITH b AS (SELECT document_id, quantity, claim_id, row_number() OVER (PARTITION BY document_id, quantity ORDER BY CASE WHEN lower(comparator) IN ('<', '<=', '≤', 'between', '=', 'less than', 'lower than', 'below', 'under') THEN 0 ELSE 1 END, claim_id) AS rn FROM claim WHERE value IS NOT NULL AND comparator IS NOT NULL)
SELECT document_id, quantity, claim_id FROM b WHERE rn = 1""")
def headline_claim(spark, d):
    b = _bounds(spark, d)
    order = F.struct((F.lower("comparator").isin(*_ABOVE)).cast("int").alias("open"), "claim_id")
    return b.groupBy("document_id", "quantity").agg(F.min(order).alias("m")).select("document_id", "quantity", "m.claim_id")


@query("""WITH b AS (SELECT quantity, unit, population, publisher, CASE WHEN c IN ('<', '<=', '≤', 'less than', 'lower than', 'below', 'under') THEN CAST(0 AS DOUBLE) ELSE value END AS low,
 CASE WHEN c IN ('>', '>=', '≥', 'greater than', 'more than', 'above', 'over', 'at least') THEN CAST('Infinity' AS DOUBLE) WHEN c = 'between' THEN value_high ELSE value END AS high FROM (SELECT *, lower(comparator) AS c FROM claim) WHERE value IS NOT NULL AND c IS NOT NULL),
g AS (SELECT quantity, unit, population, count(DISTINCT publisher) AS sources, max(low) AS ml, min(high) AS mh, count(DISTINCT CASE WHEN low IS NOT NULL AND high IS NOT NULL THEN (low, high) END) AS n FROM b GROUP BY ALL)
SELECT quantity, unit, population, sources, CASE WHEN ml > mh THEN 'incompatible' WHEN n > 1 THEN 'differs' ELSE 'agree' END AS status FROM g WHERE sources >= 2""")
def claim_agreement(spark, d):
    return metrics.agreement(_bounds(spark, d), ["quantity", "unit", "population"], "publisher", "low", "high")


_CLAIM = re.compile(r"(?:(less than|lower than|below|under|more than|greater than|above|over|at least|exceeds|falls below|[<>≤≥]=?)\s)?(?:between\s(\d+(?:\.\d+)?)\sand\s)?(\d+(?:\.\d+)?)\s?(mL/min/1\.73 m²|mg/mmol|mmol/L|µmol/L|mg/g|mmHg|g/L|%)")


@query()
def claims(spark, d):
    """Numeric claims of the evidence texts: comparator, value or range, unit, and who it is about."""

    def run(it):
        for pdf in it:
            rows = []
            for i, t in zip(pdf["ev_id"], pdf["raw_text"], strict=True):
                for n, m in enumerate(_CLAIM.finditer(t or "")):
                    around = t[max(0, m.start() - 120) : m.end() + 40].lower()
                    who = next((p for p in ("pregnan", "child", "adolescent", "transplant", "dialysis") if p in around), None)
                    lo, hi = (float(m[2]), float(m[3])) if m[2] else (float(m[3]), None)
                    rows.append((i, n, "between" if m[2] else m[1] or "=", lo, hi, m[4], who))
            yield pd.DataFrame(rows, columns=["ev_id", "claim_no", "comparator", "value", "value_high", "unit", "population"])

    return table(spark, d, PACK, "ev_id", "raw_text").mapInPandas(run, "ev_id bigint, claim_no int, comparator string, value double, value_high double, unit string, population string")


@query(f"""WITH a AS (SELECT query_id, string_agg(substr(raw_text, 1, 200) || ' [' || (rank + CASE WHEN rank % 3 = 0 THEN 90 ELSE 0 END) || ']', ' ' ORDER BY rank, id) AS answer, count(*) AS n FROM {PACK} GROUP BY query_id),
c AS (SELECT query_id, n, list_transform(regexp_extract_all(answer, '\\[([0-9]+)\\]', 1), lambda x: CAST(x AS INT)) AS c FROM a)
SELECT query_id, CAST(len(list_filter(c, lambda x: x BETWEEN 1 AND n)) AS BIGINT) AS valid, CAST(len(c) AS BIGINT) AS cited FROM c""")
def citation_check(spark, d):
    e = table(spark, d, PACK, "query_id", "rank", "id", "raw_text")
    mark = F.col("rank") + F.when(F.col("rank") % 3 == 0, 90).otherwise(0)
    piece = F.concat(F.substring("raw_text", 1, 200), F.lit(" ["), mark.cast("string"), F.lit("]"))
    g = e.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", piece.alias("t")))).alias("x"), F.count("*").alias("n"))
    answer = F.array_join(F.transform("x", lambda s: s["t"]), " ")
    cited = F.transform(F.regexp_extract_all(answer, F.lit(r"\[([0-9]+)\]"), F.lit(1)), lambda x: x.cast("int"))
    c = g.select("query_id", "n", cited.alias("c"))
    return c.select("query_id", F.size(F.filter("c", lambda x: x.between(1, F.col("n")))).cast("bigint").alias("valid"), F.size("c").cast("bigint").alias("cited"))


@query(r"""WITH c AS (SELECT claim_id, span, unit, CASE WHEN contains(value::VARCHAR, 'e') THEN regexp_replace(CAST(value AS DECIMAL(38, 15))::VARCHAR, '\.?0+$', '') ELSE regexp_replace(value::VARCHAR, '\.0$', '') END AS v FROM claim WHERE value IS NOT NULL AND unit IS NOT NULL AND span IS NOT NULL)
SELECT claim_id, contains(lower(regexp_replace(span, '\s+', '', 'g')), lower(regexp_replace(v || unit, '\s+', '', 'g'))) AS supported FROM c""")
def value_support(spark, d):
    c = table(spark, d, "claim").where("value is not null and unit is not null and span is not null")
    need = metrics.squeezed(F.concat(T.plain_number(F.col("value")), "unit"))
    return c.select("claim_id", metrics.squeezed(F.col("span")).contains(need).alias("supported"))


@query()
def verify(spark, d):
    """Answers made of the first evidence's first sentence, checked against the pack's evidence."""
    e = table(spark, d, PACK, "query_id", "rank", "id", "raw_text")
    g = e.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "raw_text"))).alias("x"))
    a = g.select("query_id", F.transform("x", lambda s: s["raw_text"]).alias("evidence"))
    a = a.withColumn("answer", F.concat(F.substring_index(F.col("evidence")[0], ". ", 1), F.lit(" [1]")))
    return metrics.verify(a, "query_id", "answer", "evidence")


# Triggers over events


@query("""SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS first_event, arg_min(value, (ts, event_id)) AS first_value FROM events GROUP BY user_id, event_type""")
def first_fact_per_user(spark, d):
    e = table(spark, d, "events", "user_id", "event_type", "ts", "event_id", "value")
    return e.groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id", "value")).alias("m")).select("user_id", "event_type", F.col("m.event_id").alias("first_event"), F.col("m.value").alias("first_value"))


@query("""WITH f AS (SELECT user_id, max(value) FILTER (event_type = 'error') AS e, avg(value) FILTER (event_type = 'purchase') AS p, count(*) FILTER (event_type = 'click') AS c FROM events GROUP BY user_id)
SELECT user_id, coalesce(e > 50, false) AS high_error, coalesce(p > 20, false) AS high_spend, c >= 10 AND coalesce(p, 0) = 0 AS browsing FROM f""")
def triggers(spark, d):
    def of(kind):
        return F.col("event_type") == kind

    f = table(spark, d, "events", "user_id", "event_type", "value").groupBy("user_id").agg(
        F.max(F.when(of("error"), F.col("value"))).alias("e"), F.avg(F.when(of("purchase"), F.col("value"))).alias("p"), F.count_if(of("click")).alias("c")
    )
    return f.select("user_id", F.coalesce(F.col("e") > 50, F.lit(False)).alias("high_error"), F.coalesce(F.col("p") > 20, F.lit(False)).alias("high_spend"), ((F.col("c") >= 10) & (F.coalesce("p", F.lit(0.0)) == 0)).alias("browsing"))


@query(r"""WITH l AS (SELECT sample_id, string_split(regexp_replace(text, '\. ', E'\n', 'g'), E'\n') AS ls FROM question_sample2 WHERE text IS NOT NULL), n AS (SELECT sample_id, unnest(list_transform(range(1, len(ls) + 1), lambda i: i || '|' || ls[i])) AS line FROM l)
SELECT sample_id, CAST(regexp_extract(line, '^([0-9]+)\|(.+)$', 1) AS INT) AS n, trim(regexp_extract(line, '^([0-9]+)\|(.+)$', 2)) AS question FROM n WHERE regexp_matches(line, '^[0-9]+\|.+$')""")
def parse_numbered_lines(spark, d):
    q = table(spark, d, "question_sample2").where("text is not null").select("sample_id", F.posexplode(F.split(F.regexp_replace("text", r"\. ", "\n"), "\n")).alias("p", "l"))
    line = q.select("sample_id", F.concat_ws("|", (F.col("p") + 1).cast("string"), "l").alias("line")).where(F.col("line").rlike(r"^[0-9]+\|.+$"))
    return line.select("sample_id", F.regexp_extract("line", r"^([0-9]+)\|(.+)$", 1).cast("int").alias("n"), F.trim(F.regexp_extract("line", r"^([0-9]+)\|(.+)$", 2)).alias("question"))


@query("""WITH t AS (SELECT sample_id FROM question_sample2 q WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(map_keys(relevance)) AS id FROM ckd_gold_eval) g WHERE g.id = q.id))
SELECT sample_id, CAST((row_number() OVER (PARTITION BY sample_id % 16 ORDER BY sample_id) - 1) // 8 AS BIGINT) AS batch FROM t""")
def batch_todo(spark, d):
    """Items without questions yet, in batches of eight within sixteen lanes: no global order is needed."""
    g = table(spark, d, "ckd_gold_eval").select(F.explode(F.map_keys("relevance")).alias("id"))
    t = table(spark, d, "question_sample2", "sample_id", "id").join(g, "id", "left_anti")
    w = Window.partitionBy(F.col("sample_id") % 16).orderBy("sample_id")
    return t.select("sample_id", F.floor((F.row_number().over(w) - 1) / 8).alias("batch"))


# Evaluation of the search


JUDGED = f"judged AS (SELECT case_key AS qid, sample_id, CAST(max(grade) AS INT) AS grade FROM (SELECT case_key, unnest(map_keys(relevance)) AS id, unnest(map_values(relevance)) AS grade FROM (SELECT case_key, relevance FROM ckd_gold_eval UNION ALL SELECT case_key, relevance FROM heldout_chunkfirst) WHERE case_key % {R.EVERY} = 0) JOIN question_sample2 USING (id) GROUP BY ALL)"


def judged(spark, d, whole=False):
    g = R.cases(spark, d, whole).select("qid", F.explode("relevance").alias("id", "grade"))
    return g.join(table(spark, d, "question_sample2", "id", "sample_id"), "id").groupBy("qid", "sample_id").agg(F.max("grade").alias("grade"))


METRICS = f"""{R.HYBRID}, {JUDGED}, g AS (SELECT h.qid, rank, coalesce(grade, 0) AS grade FROM hybrid h LEFT JOIN judged j ON j.qid = h.qid AND j.sample_id = h.sample_id),
per AS (SELECT qid, sum(grade / log2(rank + 1)) AS dcg, count(*) FILTER (grade > 0) AS found, count(*) FILTER (grade > 0 AND rank <= 5) AS found5, min(rank) FILTER (grade = 2) AS first2, min(rank) FILTER (grade > 0) AS first FROM g GROUP BY qid),
ideal AS (SELECT qid, sum(CASE WHEN r <= 10 THEN grade / log2(r + 1) ELSE 0 END) AS ideal, count(*) FILTER (grade > 0) AS relevant FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, sample_id) AS r FROM judged) GROUP BY qid),
m AS (SELECT i.qid, CASE WHEN ideal > 0 THEN coalesce(dcg, 0) / ideal ELSE 0 END AS ndcg, coalesce(found, 0) / CAST(relevant AS DOUBLE) AS recall, coalesce(found5, 0) / 5.0 AS p5, coalesce(1.0 / first2, 0) AS rr, first, relevant FROM ideal i LEFT JOIN per USING (qid) WHERE relevant > 0)"""


def _metrics(spark, d, whole=False):
    return metrics.ir_metrics(R.run(spark, d, whole=whole).select("qid", "sample_id", "rank"), judged(spark, d, whole), "qid", "sample_id")


@query(f"WITH {METRICS} SELECT qid, round(ndcg, 4) AS ndcg FROM m")
def ndcg(spark, d):
    return _metrics(spark, d).select("qid", F.round("ndcg", 4).alias("ndcg"))


@query(f"WITH {METRICS} SELECT qid, round(recall, 4) AS recall, CAST(round(p5, 4) AS DOUBLE) AS p5, CAST(round(rr, 4) AS DOUBLE) AS rr, CAST(first AS INT) AS first, relevant FROM m")
def ir_metrics(spark, d):
    return _metrics(spark, d).select("qid", F.round("recall", 4).alias("recall"), F.round("p5", 4).alias("p5"), F.round("rr", 4).alias("rr"), "first", "relevant")


@query(R.whole(f"WITH {METRICS} SELECT CAST(k AS INT) AS k, round(CAST(count(*) FILTER (first <= k) AS DOUBLE) / count(*), 6) AS success FROM m, (VALUES (1), (3), (5), (10)) v(k) GROUP BY k"))
def success_at_k(spark, d):
    m = _metrics(spark, d, True).select(F.explode(F.array(*map(F.lit, (1, 3, 5, 10)))).alias("k"), "first")
    return m.groupBy("k").agg(F.round(F.count_if(F.col("first") <= F.col("k")) / F.count("*"), 6).alias("success"))


@query(R.whole(f"WITH {METRICS} SELECT round(avg(p5), 6) AS p5, round(avg(least(relevant, 5) / 5.0), 6) AS ceiling FROM m"))
def precision_ceiling(spark, d):
    return _metrics(spark, d, True).agg(F.round(F.avg("p5"), 6).alias("p5"), F.round(F.avg(F.least("relevant", F.lit(5)) / 5.0), 6).alias("ceiling"))


@query(R.whole(f"""WITH {METRICS}, c AS (SELECT qid, lower(trim(slice)) AS slice, kind, category FROM (SELECT case_key AS qid, slice, kind, category FROM ckd_gold_eval UNION ALL SELECT case_key, slice, kind, category FROM heldout_chunkfirst))
SELECT CAST(grouping(slice) AS INT) AS g1, CAST(grouping(kind) AS INT) AS g2, CAST(grouping(category) AS INT) AS g3, slice, kind, category, count(*) AS n, round(avg(round(ndcg, 4)), 6) AS ndcg, count(*) FILTER (round(ndcg, 4) = 0) AS missed FROM m JOIN c USING (qid) GROUP BY GROUPING SETS ((), (slice), (kind), (category))"""))
def metrics_grouping_sets(spark, d):
    own = ["case_key", "slice", "kind", "category"]
    c = table(spark, d, "ckd_gold_eval", *own).unionByName(table(spark, d, "heldout_chunkfirst", *own)).withColumnRenamed("case_key", "qid").withColumn("slice", F.lower(F.trim("slice")))
    m = _metrics(spark, d, True).select("qid", F.round("ndcg", 4).alias("v")).join(c, "qid")
    g = m.groupingSets([[], ["slice"], ["kind"], ["category"]], "slice", "kind", "category")
    return g.agg(
        F.grouping("slice").cast("int").alias("g1"), F.grouping("kind").cast("int").alias("g2"), F.grouping("category").cast("int").alias("g3"),
        F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("ndcg"), F.count_if(F.col("v") == 0).alias("missed"),
    )


@query(f"WITH {METRICS} SELECT qid FROM m WHERE round(ndcg, 4) = 0")
def total_miss(spark, d):
    return _metrics(spark, d).where("round(ndcg, 4) = 0").select("qid")


@query(R.whole(f"""WITH {R.HYBRID}, {JUDGED} SELECT qid, array_to_string(list_sort(list(sample_id)), ',') AS missed FROM judged ANTI JOIN hybrid USING (qid, sample_id) WHERE grade > 0 GROUP BY qid"""))
def missed_list(spark, d):
    m = judged(spark, d, True).where("grade > 0").join(R.run(spark, d, whole=True), ["qid", "sample_id"], "left_anti")
    return m.groupBy("qid").agg(F.array_join(F.array_sort(F.collect_list("sample_id")), ",").alias("missed"))  # the judgements of one query


@query(f"""WITH {R.HYBRID}, {JUDGED}, f AS (SELECT sample_id, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS fp FROM chunks), jf AS (SELECT qid, fp, max(grade) AS grade FROM judged JOIN f USING (sample_id) GROUP BY ALL),
r AS (SELECT qid, rank, fp, row_number() OVER (PARTITION BY qid, fp ORDER BY rank) AS rn FROM hybrid JOIN f USING (sample_id))
SELECT r.qid, round(sum(CASE WHEN rn = 1 THEN coalesce(grade, 0) ELSE 0 END / log2(rank + 1)), 4) AS dcg FROM r LEFT JOIN jf ON jf.qid = r.qid AND jf.fp = r.fp GROUP BY r.qid""")
def collapsed_metrics(spark, d):
    """Gains over texts, not rows: repeats of a text keep their rank but gain nothing."""
    f = R.chunks(spark, d).select("sample_id", T.fingerprint(F.col("text")).alias("fp"))
    jf = judged(spark, d).join(f, "sample_id").groupBy("qid", "fp").agg(F.max("grade").alias("grade"))
    w = Window.partitionBy("qid", "fp").orderBy("rank")
    r = R.run(spark, d).join(f, "sample_id").withColumn("rn", F.row_number().over(w))
    gain = F.when(F.col("rn") == 1, F.coalesce("grade", F.lit(0))).otherwise(0)
    return r.join(jf, ["qid", "fp"], "left").groupBy("qid").agg(F.round(F.sum(gain / F.log2(F.col("rank") + 1)), 4).alias("dcg"))


@query(R.whole(f"""WITH {R.HYBRID}, g AS (SELECT case_key AS qid, should_abstain FROM ckd_gold_eval UNION ALL SELECT case_key, should_abstain FROM heldout_chunkfirst)
SELECT should_abstain, count(*) AS n, round(avg(score), 6) AS mean_top FROM hybrid JOIN g USING (qid) WHERE rank = 1 GROUP BY should_abstain"""))
def abstention_separation(spark, d):
    """How far the best scores of questions without an answer lie below those of the others."""
    own = ["case_key", "should_abstain"]
    g = table(spark, d, "ckd_gold_eval", *own).unionByName(table(spark, d, "heldout_chunkfirst", *own)).withColumnRenamed("case_key", "qid")
    return R.run(spark, d, whole=True).where("rank = 1").join(g, "qid").groupBy("should_abstain").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_top"))


@query(R.whole(f"""WITH {R.RANKED}, h AS ({R._top_sql('ranked', 20)}), {JUDGED}, f AS (SELECT qid, count(*) FILTER (rank <= 10) AS f10, count(*) AS f20 FROM h JOIN judged USING (qid, sample_id) WHERE grade > 0 GROUP BY qid), r AS (SELECT qid, count(*) AS n FROM judged WHERE grade > 0 GROUP BY qid)
SELECT qid, round(coalesce(f10, 0) / n, 6) AS recall10, round(coalesce(f20, 0) / n, 6) AS recall20 FROM r LEFT JOIN f USING (qid)"""))
def recall_at_20(spark, d):
    j = judged(spark, d, True).where("grade > 0")
    hit = R.run(spark, d, 20, True).join(j, ["qid", "sample_id"]).groupBy("qid").agg(F.count_if(F.col("rank") <= 10).alias("a"), F.count("*").alias("b"))
    r = j.groupBy("qid").agg(F.count("*").alias("n")).join(hit, "qid", "left")
    return r.select("qid", F.round(F.coalesce("a", F.lit(0)) / F.col("n"), 6).alias("recall10"), F.round(F.coalesce("b", F.lit(0)) / F.col("n"), 6).alias("recall20"))


#: variants of the search: weights of its signals, weight and depth of the rerank
_USUAL = path.Config()
_ON = {**_USUAL.weights, "rerank": _USUAL.rerank, "head": float(_USUAL.head)}
VARIANTS = {"usual": _ON} | {f"no_{s}": {**_ON, s: 0.0} for s, w in _USUAL.weights.items() if w} | {"with_band": {**_ON, "band": 0.30}, "no_rerank": {**_ON, "rerank": 0.0}}
SWEEP = {"usual": _ON} | {f"tfidf_{k}": {**_ON, "tfidf": k / 10, "dense": 0.6 - k / 10} for k in range(1, 6)} | {f"meta_{k}": {**_ON, "meta": k / 10} for k in (0, 1, 5, 7)}
SWEEP |= {f"asked_{k}": {**_ON, "asked": k / 100} for k in (5, 30, 50)} | {f"band_{k}": {**_ON, "band": k / 100} for k in (10, 25, 50)} | {f"head_{k}": {**_ON, "head": float(k)} for k in (0, 10, 50)} | {f"rerank_{k}": {**_ON, "rerank": k / 10} for k in (0, 5, 20)}


def _variants_sql(variants: dict[str, dict[str, float]]) -> str:
    rows = ", ".join(f"('{n}', " + ", ".join(f"{v[c]}::DOUBLE" for c in _ON) + ")" for n, v in variants.items())
    on = "PARTITION BY name, qid"
    return f"""{R.RANKED}, {JUDGED}, v(name, {", ".join(f"w_{c}" for c in _ON)}) AS (VALUES {rows}),
vf AS (SELECT name, w_rerank, w_head, qid, sample_id, jac, round((w_tfidf * tfidf + w_dense * dense + w_asked * asked + w_meta * meta + w_band * band) / (w_tfidf + w_dense + w_asked + w_meta + w_band) * prior_kind * prior_band * prior_quality, 9) AS fused FROM sn, v),
vp AS (SELECT *, row_number() OVER ({on} ORDER BY fused DESC, sample_id) AS place FROM vf), vh AS (SELECT *, CASE WHEN place <= w_head THEN jac END AS rr FROM vp),
vs AS (SELECT name, qid, sample_id, round(CASE WHEN place <= w_head THEN (fused + w_rerank * {R._mm('rr', on)}) / (1 + w_rerank) ELSE fused / (1 + w_rerank) END, 6) AS score FROM vh),
vt AS (SELECT name, qid, sample_id, row_number() OVER ({on} ORDER BY score DESC, sample_id) AS rank FROM vs), vg AS (SELECT name, qid, sum(grade / log2(rank + 1)) AS dcg FROM vt JOIN judged USING (qid, sample_id) WHERE rank <= 10 GROUP BY ALL),
videal AS (SELECT qid, sum(grade / log2(r + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, sample_id) AS r FROM judged) WHERE r <= 10 GROUP BY qid HAVING sum(grade) > 0),
vm AS (SELECT name, qid, coalesce(dcg, 0) / ideal AS ndcg FROM videal CROSS JOIN (SELECT name FROM v) LEFT JOIN vg USING (name, qid))"""


def _hits(spark, d, variants: dict[str, dict[str, float]], whole: bool) -> DataFrame:
    """(name, qid, sample_id, rank): the judged results among the ten best of every variant, written once."""
    name = hashlib.sha256(json.dumps([variants, whole]).encode()).hexdigest()[:12]
    return stored(spark, f"hits-{name}", R.inputs(spark, d), lambda: blocks.variants(*R.prepared(spark, d, whole, R.wide_query(), judged(spark, d, whole)), _USUAL, variants))


def variant_metrics(spark, d, variants: dict[str, dict[str, float]], whole: bool = False) -> DataFrame:
    """(name, qid, ndcg) of every variant: the search weighs its signals by each of them in one pass."""
    by = ["name", "qid"]
    t = _hits(spark, d, variants, whole)
    j = judged(spark, d, whole)
    dcg = t.join(j, ["qid", "sample_id"]).groupBy(*by).agg(F.sum(F.col("grade") / F.log2(F.col("rank") + 1)).alias("dcg"))
    best = j.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("grade"), "sample_id"))).where("r <= 10")
    ideal = best.groupBy("qid").agg(F.sum(F.col("grade") / F.log2(F.col("r") + 1)).alias("ideal"), F.sum("grade").alias("g")).where("g > 0")
    every = ideal.select("qid", "ideal", F.explode(F.array(*map(F.lit, variants))).alias("name"))
    return every.join(dcg, by, "left").select("name", "qid", (F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).alias("ndcg"))


@query(R.whole(f"""WITH {_variants_sql(VARIANTS)}, x AS (SELECT m.name, m.qid, m.ndcg, u.ndcg AS usual FROM vm m JOIN vm u ON u.qid = m.qid AND u.name = 'usual')
SELECT name, round(avg(ndcg), 6) AS ndcg, round(avg(ndcg - usual), 6) AS delta, CASE WHEN max(abs(ndcg - usual)) < 1e-9 THEN 'inert' ELSE 'matters' END AS status FROM x GROUP BY name"""))
def ablation(spark, d):
    """What each component of the search is worth in nDCG."""
    m = variant_metrics(spark, d, VARIANTS, True)
    u = m.where("name = 'usual'").select("qid", F.col("ndcg").alias("usual"))
    delta = F.col("ndcg") - F.col("usual")
    return m.join(u, "qid").groupBy("name").agg(
        F.round(F.avg("ndcg"), 6).alias("ndcg"), F.round(F.avg(delta), 6).alias("delta"), F.when(F.max(F.abs(delta)) < 1e-9, "inert").otherwise("matters").alias("status"),
    )


_SLICED = "c AS (SELECT case_key AS qid, lower(trim(slice)) AS slice FROM ckd_gold_eval UNION ALL SELECT case_key, 'heldout' FROM heldout_chunkfirst), s AS (SELECT name, CASE WHEN slice = 'dev' THEN 'dev' ELSE 'evaluation' END AS slice, round(avg(ndcg), 6) AS ndcg FROM vm JOIN c USING (qid) WHERE slice IS NOT NULL GROUP BY ALL)"


def _sliced(spark, d, whole=False):
    c = table(spark, d, "ckd_gold_eval").select(F.col("case_key").alias("qid"), F.lower(F.trim("slice")).alias("slice")).unionByName(table(spark, d, "heldout_chunkfirst").select(F.col("case_key").alias("qid"), F.lit("heldout").alias("slice")))
    m = variant_metrics(spark, d, SWEEP, whole).join(c.where("slice is not null"), "qid")
    return m.groupBy("name", F.when(F.col("slice") == "dev", "dev").otherwise("evaluation").alias("slice")).agg(F.round(F.avg("ndcg"), 6).alias("ndcg"))


@query(R.whole(f"WITH {_variants_sql(SWEEP)}, {_SLICED} SELECT * FROM s"))
def sweeps(spark, d):
    """A grid over weights, band weight, rerank depth and rerank weight, for the split that chooses and those that confirm."""
    return _sliced(spark, d, True)


@query(f"WITH {_variants_sql(SWEEP)}, {_SLICED}, b AS (SELECT arg_min(name, (-ndcg, name)) AS name FROM s WHERE slice = 'dev') SELECT name, slice, ndcg FROM s JOIN b USING (name)")
def sweep_choice(spark, d):
    """The variant that the training split chooses, with what the evaluation splits say of it."""
    s = _sliced(spark, d)
    b = s.where("slice = 'dev'").agg(F.min_by("name", F.struct(-F.col("ndcg"), "name")).alias("name"))  # one row
    return s.join(F.broadcast(b), "name").select("name", "slice", "ndcg")


def _bootstrap_sql(values: str, key: str, value: str, resamples: int = 3_000) -> str:
    weight = " + ".join(f"(u > {c!r})::INT" for c in metrics.POISSON)
    return f"""bu AS (SELECT {value} AS v, r, (('0x' || substr(md5({key} || '|' || r || '|17'), 1, 7))::BIGINT + 0.5) / {float(1 << 28)} AS u FROM {values}, range(1, {resamples + 1}) t(r)),
bm AS (SELECT r, sum(v * ({weight})) / nullif(sum({weight}), 0) AS m FROM bu GROUP BY r), bs AS (SELECT (SELECT avg({value}) FROM {values}) AS mean, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM bm)"""


@query(R.whole(f"WITH {METRICS}, {_bootstrap_sql('m', 'qid', 'ndcg')} SELECT round(mean, 6) AS mean, round(lo, 6) AS lo, round(hi, 6) AS hi FROM bs"))
def bootstrap_ci(spark, d):
    b = metrics.bootstrap(_metrics(spark, d, True).select("qid", "ndcg"), "qid", "ndcg")
    return b.select(*[F.round(c, 6).alias(c) for c in ("mean", "lo", "hi")])


_PAIR = {"usual": _ON, "lexical": {**_ON, "dense": 0.0, "asked": 0.0, "rerank": 0.0}}


@query(R.whole(f"WITH {_variants_sql(_PAIR)}, g AS (SELECT a.qid, a.ndcg - b.ndcg AS gain FROM vm a JOIN vm b ON b.qid = a.qid AND a.name = 'usual' AND b.name = 'lexical'), {_bootstrap_sql('g', 'qid', 'gain')} SELECT round(mean, 6) AS mean, round(lo, 6) AS lo, round(hi, 6) AS hi, lo > 0 OR hi < 0 AS significant FROM bs"))
def paired_bootstrap(spark, d):
    """Interval of the gain of the usual search over the lexical one, query by query."""
    m = variant_metrics(spark, d, _PAIR, True).groupBy("qid").pivot("name", list(_PAIR)).agg(F.first("ndcg"))
    b = metrics.bootstrap(m.select("qid", (F.col("usual") - F.col("lexical")).alias("gain")), "qid", "gain")
    return b.select(*[F.round(c, 6).alias(c) for c in ("mean", "lo", "hi")], ((F.col("lo") > 0) | (F.col("hi") < 0)).alias("significant"))


@query(f"""SELECT query_id, array_to_string(list_filter([CASE WHEN count(*) FILTER (citation IS NULL) > 0 THEN 'quote_without_citation' END, CASE WHEN max(score) < 0.2 THEN 'low_confidence' END,
 CASE WHEN count(DISTINCT document_id) = 1 THEN 'single_source' END, CASE WHEN count(*) <> count(DISTINCT rank) THEN 'tied_ranks' END], lambda x: x IS NOT NULL), ',') AS flags FROM {PACK} GROUP BY query_id""")
def audit_flags(spark, d):
    g = table(spark, d, PACK).groupBy("query_id").agg(F.count_if(F.col("citation").isNull()).alias("c"), F.max("score").alias("s"), F.count_distinct("document_id").alias("d"), F.count("*").alias("n"), F.count_distinct("rank").alias("r"))
    flags = F.array(F.when(F.col("c") > 0, "quote_without_citation"), F.when(F.col("s") < 0.2, "low_confidence"), F.when(F.col("d") == 1, "single_source"), F.when(F.col("n") != F.col("r"), "tied_ranks"))
    return g.select("query_id", F.array_join(F.filter(flags, lambda x: x.isNotNull()), ",").alias("flags"))


@query(f"""WITH t AS (SELECT query_id, arg_min(id, (rank, id)) AS id FROM {PACK} WHERE contains(id, '_table_row_') GROUP BY query_id), b AS (SELECT query_id, arg_max(chunk_id, (coalesce(tfidf, -1), chunk_id)) AS id FROM index_score GROUP BY query_id)
SELECT CASE WHEN t.id = b.id THEN 'right' WHEN split_part(t.id, '_p', 1) = split_part(b.id, '_p', 1) THEN 'sibling' ELSE 'other' END AS verdict, count(*) AS n FROM t JOIN b USING (query_id) GROUP BY 1""")
def row_precision(spark, d):
    t = table(spark, d, PACK, "query_id", "rank", "id").where(F.col("id").contains("_table_row_")).groupBy("query_id").agg(F.min(F.struct("rank", "id"))["id"].alias("t"))
    b = table(spark, d, "index_score", "query_id", "chunk_id", "tfidf").groupBy("query_id").agg(F.max(F.struct(F.coalesce("tfidf", F.lit(-1.0)), "chunk_id"))["chunk_id"].alias("b"))
    doc = lambda c: F.split_part(c, F.lit("_p"), F.lit(1))
    verdict = F.when(F.col("t") == F.col("b"), "right").when(doc(F.col("t")) == doc(F.col("b")), "sibling").otherwise("other")
    return t.join(b, "query_id").groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


_RULES = [("stop", "pregnan.*stop|stopped"), ("monitor", "monitoring of [a-z ]+ every"), ("dose", "dosage of")]


@query("SELECT rule, sample_id, CAST(CASE WHEN chunk_type = 'recommendation_atom' THEN 2 ELSE 1 END AS INT) AS grade FROM question_sample2, (VALUES " + ", ".join(f"('{n}', '{p}')" for n, p in _RULES) + ") r(rule, pattern) WHERE regexp_matches(lower(text), pattern)")
def reannotate(spark, d):
    """Concept rules give grades: the rules are constants, so each chunk is read once."""
    q = table(spark, d, "question_sample2")
    low = F.lower("text")
    hits = F.filter(F.array(*[F.when(low.rlike(p), F.lit(n)) for n, p in _RULES]), lambda x: x.isNotNull())
    return q.select(F.explode(hits).alias("rule"), "sample_id", F.when(F.col("chunk_type") == "recommendation_atom", 2).otherwise(1).alias("grade"))



@query("""SELECT sample_id, contains(lower(text), 'pregnan') OR contains(lower(text), 'breastfeed') AS any_of, contains(lower(text), 'women') AND contains(lower(text), 'mmol') AS all_of FROM question_sample2 WHERE text IS NOT NULL""")
def annotate_candidates(spark, d):
    low = F.lower("text")
    any_of = F.exists(F.array(F.lit("pregnan"), F.lit("breastfeed")), lambda p: low.contains(p))
    all_of = F.forall(F.array(F.lit("women"), F.lit("mmol")), lambda p: low.contains(p))
    return table(spark, d, "question_sample2").where("text is not null").select("sample_id", any_of.alias("any_of"), all_of.alias("all_of"))


@query("""WITH f AS (SELECT sample_id, id, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS fp FROM question_sample2 WHERE text IS NOT NULL), g AS (SELECT DISTINCT unnest(map_keys(relevance)) AS id FROM ckd_gold_eval)
SELECT DISTINCT f.sample_id FROM f JOIN (SELECT DISTINCT fp FROM f JOIN g USING (id)) p USING (fp) WHERE fp <> ''""")
def pin_twins(spark, d):
    f = table(spark, d, "question_sample2").where("text is not null").select("sample_id", "id", T.fingerprint(F.col("text")).alias("fp")).where("fp <> ''")
    g = table(spark, d, "ckd_gold_eval").select(F.explode(F.map_keys("relevance")).alias("id")).distinct()
    pinned = f.join(g, "id", "left_semi").select("fp").distinct()
    return f.join(pinned, "fp", "left_semi").select("sample_id")


@query("""WITH a AS (SELECT id, count(*) AS n FROM (SELECT unnest(map_keys(relevance)) AS id FROM ckd_gold_eval) GROUP BY id), r AS (SELECT a.id, n, count(q.id) AS matches FROM a LEFT JOIN question_sample2 q USING (id) GROUP BY a.id, n)
SELECT CASE WHEN matches = 0 THEN 'unresolved' WHEN matches > 4 THEN 'ambiguous' ELSE 'resolved' END AS outcome, count(*) AS anchors FROM r GROUP BY 1""")
def resolve_anchors(spark, d):
    a = table(spark, d, "ckd_gold_eval").select(F.explode(F.map_keys("relevance")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    r = a.join(table(spark, d, "question_sample2").select("id", F.lit(1).alias("one")), "id", "left").groupBy("id").agg(F.count("one").alias("matches"))
    return r.groupBy(F.when(F.col("matches") == 0, "unresolved").when(F.col("matches") > 4, "ambiguous").otherwise("resolved").alias("outcome")).agg(F.count("*").alias("anchors"))


@query("""WITH m AS (SELECT query_id, chunk_id, max(tfidf) AS a, max(dense) AS b FROM index_score GROUP BY ALL), r AS (SELECT query_id, rank() OVER (PARTITION BY query_id ORDER BY a DESC NULLS LAST) AS ra, rank() OVER (PARTITION BY query_id ORDER BY b DESC NULLS LAST) AS rb FROM m)
SELECT query_id, round(avg(CAST(rb AS DOUBLE) - CAST(ra AS DOUBLE)), 6) AS shift, CAST(max(abs(rb - ra)) AS BIGINT) AS most FROM r GROUP BY query_id""")
def run_comparison(spark, d):
    l = R.listed(spark, d)  # noqa: E741
    w = Window.partitionBy("query_id")
    r = l.select("query_id", F.rank().over(w.orderBy(F.desc_nulls_last("tfidf"))).alias("ra"), F.rank().over(w.orderBy(F.desc_nulls_last("dense"))).alias("rb"))
    return r.groupBy("query_id").agg(F.round(F.avg(F.col("rb").cast("double") - F.col("ra")), 6).alias("shift"), F.max(F.abs(F.col("rb") - F.col("ra"))).cast("bigint").alias("most"))


@query("""WITH k AS (SELECT md5(text) AS h, min(lang) AS known FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL GROUP BY 1), n AS (SELECT d.*, coalesce(d.lang, k.known) AS filled FROM documents d LEFT JOIN k ON k.h = md5(d.text)),
a AS (SELECT doc_id, text, source, n_chars, doc_kind, publisher FROM documents), b AS (SELECT doc_id, text, source, n_chars, doc_kind, publisher FROM n)
SELECT (SELECT count(*) FROM (FROM a EXCEPT ALL FROM b)) AS lost, (SELECT count(*) FROM (FROM b EXCEPT ALL FROM a)) AS added, count(*) FILTER (lang IS NULL AND filled IS NOT NULL) AS filled, count(*) FILTER (lang IS NOT NULL AND filled <> lang) AS overwritten FROM n""")
def backfill_invariant(spark, d):
    """Missing languages are filled in from copies of the text and the table is written; read back, it must
    hold the old columns of all rows, nothing else, and no language that was there may have changed."""
    docs = table(spark, d, "documents")
    h = F.md5("text")
    k = docs.where("text is not null and lang is not null").groupBy(h.alias("h")).agg(F.min("lang").alias("known"))
    made = docs.join(k, h == k.h, "left").withColumn("filled", F.coalesce("lang", "known")).drop("h", "known")
    n = stored(spark, "backfilled", [docs], lambda: made)
    own = [F.col(c) for c in ("doc_id", "text", "source", "n_chars", "doc_kind", "publisher")]
    a, b = docs.select(*own), n.select(*own)
    lost, added = a.exceptAll(b).agg(F.count("*").alias("lost")), b.exceptAll(a).agg(F.count("*").alias("added"))
    counts = n.agg(F.count_if(F.col("lang").isNull() & F.col("filled").isNotNull()).alias("filled"), F.count_if(F.col("filled") != F.col("lang")).alias("overwritten"))
    return lost.crossJoin(added).crossJoin(counts)  # one row each


@query(R.whole(f"""WITH {R.HYBRID}, {JUDGED}, need AS (SELECT qid, list_distinct(flatten(list({R._STATED}))) AS need FROM judged JOIN chunks USING (sample_id) WHERE grade = 2 GROUP BY qid),
have AS (SELECT qid, list_distinct(flatten(list({R._STATED}))) AS have FROM hybrid JOIN chunks USING (sample_id) WHERE rank <= 3 GROUP BY qid)
SELECT h.qid, CASE WHEN need IS NULL OR len(need) = 0 THEN 'skipped' WHEN len(list_intersect(need, have)) = len(need) THEN 'correct' WHEN len(list_intersect(need, have)) > 0 THEN 'partial' ELSE 'missing' END AS status, CAST(coalesce(len(need), 0) AS INT) AS needed FROM have h LEFT JOIN need n USING (qid)"""))
def answer_correctness(spark, d):
    """Whether the three best results, taken as the answer, state the values of the chunks that answer a question."""
    stated = R.chunks(spark, d).select("sample_id", T.stated_values(F.col("text")).alias("stated"))
    union = F.array_distinct(F.flatten(F.collect_list("stated")))  # values of a few chunks of one query
    need = judged(spark, d, True).where("grade = 2").join(stated, "sample_id").groupBy("qid").agg(union.alias("need"))
    have = R.run(spark, d, whole=True).where("rank <= 3").join(stated, "sample_id").groupBy("qid").agg(union.alias("have"))
    j = have.join(need, "qid", "left")
    common = F.size(F.array_intersect("need", "have"))
    status = F.when(F.col("need").isNull() | (F.size("need") == 0), "skipped").when(common == F.size("need"), "correct").when(common > 0, "partial").otherwise("missing")
    return j.select("qid", status.alias("status"), F.coalesce(F.size("need"), F.lit(0)).alias("needed"))


@query()
def pack_passages(spark, d):
    """Narrative lines packed into passages of about 900 characters per document, headings kept in front;
    greedy with reset, hence one pass per document in Python."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, heading = [], None
        for i, t in zip(pdf["doc_id"], pdf["text"], strict=True):
            held: list[str] = []
            n = 0

            def flush() -> None:
                nonlocal held, n
                body = " ".join(held)
                if len(body) >= 90:
                    rows.append((i, n, heading, len(body)))
                    n += 1
                held = []

            heading = None
            for line in (t or "").split("\n"):
                s = line.strip()
                if re.match(r"\d+\.\d+ ", s):
                    flush()
                    heading = s
                elif s:
                    held.append(s)
                    if sum(map(len, held)) >= 900:
                        flush()
            flush()
        return pd.DataFrame(rows, columns=["doc_id", "passage", "heading", "n_chars"])

    return table(spark, d, "documents", "doc_id", "text").mapInPandas(lambda it: map(pack, it), "doc_id bigint, passage int, heading string, n_chars int")


