"""Queries that build and audit the corpus: records, atoms, labels, regions, contexts, expansions."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Window, functions as F

from tarnwell.functions import text as T
from tarnwell.operators import encoders, fusion, index, signals
from tarnwell.plans import evaluation as E, retrieval as R
from tarnwell.plans.text import PREFIX, SQUEEZE, pages
from tarnwell.runtime import ensure_checkpoint_dir
from tarnwell.sources import read_jsonl, table, write_report
from tarnwell.streaming import jobs

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


PAGE_LINES = r"""l AS (SELECT row_id, document_id, page, i AS line_no, trim(ls[i]) AS line FROM (SELECT row_id, document_id, page, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT row_id, document_id, page, string_split(text, E'\n') AS ls FROM page_record WHERE text IS NOT NULL)))"""


def page_lines(spark, d):
    ls = pages(spark, d).where("text is not null").select("row_id", "document_id", "page", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    return ls.select("row_id", "document_id", "page", (F.col("p") + 1).cast("bigint").alias("line_no"), F.trim("line").alias("line"))


_ATOM = r"^(Practice Point|Recommendation) [0-9]+\.[0-9]+\.[0-9]+:"


@query(f"""WITH {PAGE_LINES}, g AS (SELECT *, sum(CASE WHEN regexp_matches(line, '{_ATOM}') THEN 1 ELSE 0 END) OVER (PARTITION BY row_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS atom FROM l)
SELECT row_id, CAST(atom AS BIGINT) AS atom, min(line) FILTER (regexp_matches(line, '{_ATOM}')) AS label, md5(string_agg(line, ' ' ORDER BY line_no) FILTER (line <> '' AND NOT regexp_matches(line, '{_ATOM}'))) AS body_md5, count(*) FILTER (line <> '') AS n_lines
FROM g WHERE atom > 0 GROUP BY row_id, atom""")
def recommendation_atoms(spark, d):
    """A label line starts an atom that takes in the lines up to the next label."""
    w = Window.partitionBy("row_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    is_label = F.col("line").rlike(_ATOM)
    g = page_lines(spark, d).withColumn("atom", F.sum(is_label.cast("bigint")).over(w)).where("atom > 0")
    body = F.collect_list(F.when((F.col("line") != "") & ~is_label, F.struct("line_no", "line")))  # lines of one page
    return g.groupBy("row_id", "atom").agg(
        F.min(F.when(is_label, F.col("line"))).alias("label"), body.alias("x"), F.count_if(F.col("line") != "").alias("n_lines")
    ).select("row_id", "atom", "label", F.when(F.size("x") > 0, F.md5(F.array_join(F.transform(F.array_sort("x"), lambda s: s["line"]), " "))).alias("body_md5"), "n_lines")


@query(f"""WITH p AS (SELECT row_id, document_id, page, text FROM page_record WHERE text IS NOT NULL AND text <> ''), j AS (SELECT a.row_id, b.row_id AS other, least(length(a.text), length(b.text)) AS shorter, {PREFIX.format(a='a.text', b='b.text')} AS prefix
 FROM p a JOIN p b ON a.document_id = b.document_id AND a.page = b.page AND a.row_id <> b.row_id),
k AS (SELECT *, rank() OVER (PARTITION BY row_id ORDER BY prefix DESC) AS r, count(*) OVER (PARTITION BY row_id, prefix) AS ties FROM j WHERE prefix >= 30)
SELECT row_id, other, prefix FROM k WHERE r = 1 AND ties = 1 AND prefix >= 0.5 * shorter""")
def best_prefix_match(spark, d):
    """The other parse of a page that shares the longest beginning, if it is long enough and unique."""
    p = pages(spark, d).where("text is not null and text <> ''").select("row_id", "document_id", "page", "text")
    o = p.select("document_id", "page", F.col("row_id").alias("other"), F.col("text").alias("t2"))
    j = p.join(o, ["document_id", "page"]).where("row_id <> other")
    j = j.select("row_id", "other", F.least(F.length("text"), F.length("t2")).alias("shorter"), T.common_prefix(F.col("text"), F.col("t2")).cast("bigint").alias("prefix")).where("prefix >= 30")
    k = j.withColumn("r", F.rank().over(Window.partitionBy("row_id").orderBy(F.desc("prefix")))).withColumn("ties", F.count("*").over(Window.partitionBy("row_id", "prefix")))
    return k.where("r = 1 and ties = 1 and prefix >= 0.5 * shorter").select("row_id", "other", "prefix")


@query(f"""WITH {PAGE_LINES} SELECT row_id, line_no, CASE WHEN regexp_matches(line, '^Table [0-9]+') THEN regexp_extract(line, '^Table [0-9]+', 0) WHEN line = '' THEN 'Table' ELSE 'Table (' || substr(line, 1, 48) || ')' END AS label
FROM l WHERE line LIKE 'Table%' OR line LIKE '%table%'""")
def table_label(spark, d):
    line = F.col("line")
    label = F.when(line.rlike("^Table [0-9]+"), F.regexp_extract(line, "^Table [0-9]+", 0)).when(line == "", "Table").otherwise(F.concat(F.lit("Table ("), F.substring(line, 1, 48), F.lit(")")))
    return page_lines(spark, d).where(line.startswith("Table") | line.contains("table")).select("row_id", "line_no", label.alias("label"))


@query(f"""WITH {PAGE_LINES}, c AS (SELECT row_id, line_no AS c_no, line AS caption FROM l WHERE regexp_matches(line, '^(Table|Figure) [0-9]+')), r AS (SELECT row_id, line_no FROM l WHERE len(string_split(line, '|')) = 3),
m AS (SELECT r.row_id, r.line_no, max(c_no) AS c_no FROM r JOIN c ON c.row_id = r.row_id AND c.c_no < r.line_no GROUP BY ALL) SELECT row_id, c_no AS line_no, count(*) AS n_rows FROM m GROUP BY row_id, c_no""")
def caption_regions(spark, d):
    """Table rows belong to the last caption above them: a carried-over value, not a range join."""
    w = Window.partitionBy("row_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    ls = page_lines(spark, d).withColumn("c_no", F.last(F.when(F.col("line").rlike("^(Table|Figure) [0-9]+"), F.col("line_no")), ignorenulls=True).over(w))
    rows = ls.where((F.size(F.split("line", r"\|")) == 3) & F.col("c_no").isNotNull() & (F.col("c_no") < F.col("line_no")))
    return rows.groupBy("row_id", F.col("c_no").alias("line_no")).agg(F.count("*").alias("n_rows"))


@query("""SELECT document_id, page, arg_max(row_id, (ingested_at, row_id)) AS last_row, arg_min(row_id, (ingested_at, row_id)) AS first_row, count(*) AS parses FROM page_record GROUP BY document_id, page""")
def section_by_page(spark, d):
    p = pages(spark, d).groupBy("document_id", "page").agg(F.max(F.struct("ingested_at", "row_id")).alias("b"), F.min(F.struct("ingested_at", "row_id")).alias("a"), F.count("*").alias("parses"))
    return p.select("document_id", "page", F.col("b.row_id").alias("last_row"), F.col("a.row_id").alias("first_row"), "parses")


@query(f"""WITH {PAGE_LINES} SELECT row_id, line_no, regexp_matches(lower(line), 'notes on|use of') AND NOT regexp_matches(lower(line), 'cautions|rationale') AS defines FROM l WHERE regexp_matches(line, '^[0-9]+\\.[0-9]+ ')""")
def category_definition(spark, d):
    low = F.lower("line")
    return page_lines(spark, d).where(F.col("line").rlike(r"^[0-9]+\.[0-9]+ ")).select("row_id", "line_no", (low.rlike("notes on|use of") & ~low.rlike("cautions|rationale")).alias("defines"))


@query(f"""SELECT sample_id, split_part(text, '. ', 1) AS title, CASE WHEN contains(text, '. ') THEN substr(text, length(split_part(text, '. ', 1)) + 3) ELSE '' END AS body, concat_ws(' > ', coalesce(chunk_type, 'chunk'), 'page ' || page_start) AS path FROM question_sample2 WHERE text IS NOT NULL""")
def retrieval_record(spark, d):
    q = table(spark, d, "question_sample2").where("text is not null")
    title = F.split_part("text", F.lit(". "), F.lit(1))
    body = F.when(F.col("text").contains(". "), F.substring(F.col("text"), F.length(title) + 3, F.length("text"))).otherwise("")
    return q.select("sample_id", title.alias("title"), body.alias("body"), F.concat_ws(" > ", F.coalesce("chunk_type", F.lit("chunk")), F.concat(F.lit("page "), F.col("page_start").cast("string"))).alias("path"))


@query("""SELECT DISTINCT id, case_key, query FROM (SELECT case_key, query, unnest(map_keys(relevance)) AS id FROM ckd_gold_eval WHERE query IS NOT NULL)""")
def hype_questions(spark, d):
    g = table(spark, d, "ckd_gold_eval", "case_key", "query", "relevance").where("query is not null")
    return g.select(F.explode(F.map_keys("relevance")).alias("id"), "case_key", "query").distinct()


@query("""WITH n AS (SELECT id, min(note) AS context FROM (SELECT note, unnest(map_keys(relevance)) AS id FROM ckd_gold_eval WHERE note IS NOT NULL) GROUP BY id) SELECT q.sample_id, n.context, n.context IS NOT NULL AS has_context FROM question_sample2 q LEFT JOIN n USING (id)""")
def apply_context(spark, d):
    n = table(spark, d, "ckd_gold_eval").where("note is not null").select("note", F.explode(F.map_keys("relevance")).alias("id")).groupBy("id").agg(F.min("note").alias("context"))
    return table(spark, d, "question_sample2", "sample_id", "id").join(n, "id", "left").select("sample_id", "context", F.col("context").isNotNull().alias("has_context"))


@query("""SELECT case_key, length(note) >= 20 AND len(regexp_extract_all(note, '[^ ]+', 0)) >= 5 AND regexp_matches(note, '[.!?a-z]$') AS usable FROM ckd_gold_eval WHERE note IS NOT NULL""")
def context_usable(spark, d):
    n = F.col("note")
    return table(spark, d, "ckd_gold_eval").where("note is not null").select("case_key", ((F.length(n) >= 20) & (F.size(F.regexp_extract_all(n, F.lit("[^ ]+"), F.lit(0))) >= 5) & n.rlike("[.!?a-z]$")).alias("usable"))


@query("""SELECT claim_id, regexp_replace(lower(trim(unit)), '\\s+', '', 'g') AS unit FROM claim WHERE unit IS NOT NULL""")
def unit_normalize(spark, d):
    return table(spark, d, "claim").where("unit is not null").select("claim_id", F.regexp_replace(F.lower(F.trim("unit")), r"\s+", "").alias("unit"))


@query("""SELECT ev_id, coalesce(regexp_extract(citation, 'p\\. ([0-9]+)', 1), '') AS cited, regexp_extract(id, '_p([0-9]+)_', 1) AS actual, coalesce(regexp_extract(citation, 'p\\. ([0-9]+)', 1) = regexp_extract(id, '_p([0-9]+)_', 1), false) AS same FROM pregnancy_scope_evidence_pack""")
def page_audit(spark, d):
    cited, actual = F.regexp_extract("citation", r"p\. ([0-9]+)", 1), F.regexp_extract("id", "_p([0-9]+)_", 1)
    return table(spark, d, PACK).select("ev_id", F.coalesce(cited, F.lit("")).alias("cited"), actual.alias("actual"), F.coalesce(cited == actual, F.lit(False)).alias("same"))


# A second index over questions, and scores against it


_EXP = f"""e AS (SELECT id AS cid, string_agg(query, ' ' ORDER BY case_key) AS text FROM (SELECT case_key, query, unnest(map_keys(relevance)) AS id FROM ckd_gold_eval WHERE query IS NOT NULL AND case_key % {R.EVERY} <> 0) GROUP BY id)"""


@query(f"""WITH {R.ASKED}, {_EXP}, {R._grams('dc', 'e', 'cid', 'text')}, {R.VOCAB.replace('FROM chunks', 'FROM e')}, {R._weights('dw', 'dc', 'cid')}, {R._grams('qc', 'asked', 'qid', 'query')}, {R._weights('qw', 'qc', 'qid')},
s AS (SELECT qid, cid, sum(qw.w * dw.w) AS score FROM qw JOIN dw USING (term) GROUP BY qid, cid) {R._top_sql('s', 10, 'cid')}""")
def expansion_search(spark, d):
    """Questions searched against the questions that chunks answer, those of the search left out."""
    g = table(spark, d, "ckd_gold_eval", "case_key", "query", "relevance").where(f"query is not null and case_key % {R.EVERY} <> 0")
    pairs = g.select("case_key", "query", F.explode(F.map_keys("relevance")).alias("cid"))
    texts = pairs.groupBy("cid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("case_key", "query"))), lambda x: x["query"]), " ").alias("text"))
    counts = index.term_counts(texts, "cid", "text")
    vocab = index.vocabulary(counts, texts)
    q = index.weigh(index.term_counts(R.asked(spark, d), "qid", "query"), vocab, "qid")
    return R._top(index.cosine(q, index.weigh(counts, vocab, "cid"), "qid", "cid"), 10, "cid")


# Display and selection


@query()
def distinct_quotes(spark, d):
    """Quotes of a pack without repeated documents' labels or texts: first by rank wins, and a row dropped
    for its label does not bar its text.  A pack is one query's ranks, so a group fits in one task."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        labels, prints, keep = set(), set(), []
        for r in pdf.sort_values(["rank", "id"]).itertuples():
            if r.label in labels or (r.fp and r.fp in prints):
                continue
            labels.add(r.label)
            prints.add(r.fp)
            keep.append((r.query_id, r.id, r.rank))
        return pd.DataFrame(keep, columns=["query_id", "id", "rank"])

    e = table(spark, d, PACK).select("query_id", "id", "rank", F.regexp_extract("id", r"^(.*)_[0-9]+$", 1).alias("label"), T.fingerprint(F.col("raw_text"), 120).alias("fp"))
    return e.groupBy("query_id").applyInPandas(pick, "query_id string, id string, rank int")


@query(f"""SELECT query_id, rank, id, coalesce(citation, document_id) AS source, substr({SQUEEZE.format('raw_text')}, 1, 240) AS quote FROM {PACK}""")
def evidence_items(spark, d):
    return table(spark, d, PACK).select("query_id", "rank", "id", F.coalesce("citation", "document_id").alias("source"), T.snippet(F.col("raw_text")).alias("quote"))


@query(f"""SELECT query_id, round(max(score), 6) AS best, max(score) >= 0.62 AND count(citation) > 0 AS confident FROM {PACK} GROUP BY query_id""")
def confidence_gate(spark, d):
    g = table(spark, d, PACK).groupBy("query_id").agg(F.max("score").alias("s"), F.count("citation").alias("c"))
    return g.select("query_id", F.round("s", 6).alias("best"), ((F.col("s") >= 0.62) & (F.col("c") > 0)).alias("confident"))


_CARDS = [("high_error", "Check the error"), ("high_spend", "Thank the buyer"), ("browsing", "Offer help")]


@query("WITH f AS (" + E.SQL["triggers"] + "), c AS (" + " UNION ALL ".join(f"SELECT user_id, {k} AS ord, '{t}' AS card FROM f WHERE {n}" for k, (n, t) in enumerate(_CARDS)) + ") SELECT user_id, card, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ord) AS INT) AS place FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ord) <= 2")
def cards(spark, d):
    f = E.triggers(spark, d)
    held = F.filter(F.array(*[F.when(F.col(n), F.struct(F.lit(k).alias("ord"), F.lit(t).alias("card"))) for k, (n, t) in enumerate(_CARDS)]), lambda x: x.isNotNull())
    return f.select("user_id", F.posexplode(F.slice(held, 1, 2)).alias("p", "c")).select("user_id", "c.card", (F.col("p") + 1).alias("place"))


@query("""SELECT md5(query || '|' || raw_text) AS memo, count(*) AS uses FROM pregnancy_scope_evidence_pack WHERE query IS NOT NULL AND raw_text IS NOT NULL GROUP BY 1""")
def rerank_memo(spark, d):
    """Distinct (query, text) pairs: each is scored once, whatever the number of settings."""
    e = table(spark, d, PACK).where("query is not null and raw_text is not null")
    return e.groupBy(F.md5(F.concat_ws("|", "query", "raw_text")).alias("memo")).agg(F.count("*").alias("uses"))


# Experiments


_GRID = [k / 10 for k in range(11)]


@query(f"""WITH {R.SCALED}, g AS (SELECT CAST(unnest(range(0, 11)) AS DOUBLE) / 10 AS w), f AS (SELECT w, query_id, chunk_id, round(w * tfidf + (1 - w) * dense, 9) AS fused FROM scaled, g), t AS (SELECT w, query_id, chunk_id, row_number() OVER (PARTITION BY w, query_id ORDER BY fused DESC, chunk_id) AS r FROM f)
SELECT w, round(avg(CASE WHEN p.id IS NOT NULL THEN 1.0 / r ELSE 0.0 END), 6) AS mean_rr FROM t LEFT JOIN {PACK} p ON p.query_id = t.query_id AND p.id = t.chunk_id WHERE r <= 10 GROUP BY w""")
def weight_sweep(spark, d):
    """A grid of fusion weights in one plan."""
    s = fusion.minmax(R.listed(spark, d), "query_id", ["tfidf", "dense"]).select("query_id", "chunk_id", "tfidf", "dense", F.explode(F.array(*map(F.lit, _GRID))).alias("w"))
    f = s.select("w", "query_id", "chunk_id", F.round(F.col("w") * F.col("tfidf") + (1 - F.col("w")) * F.col("dense"), 9).alias("fused"))
    t = f.withColumn("r", F.row_number().over(Window.partitionBy("w", "query_id").orderBy(F.desc("fused"), "chunk_id"))).where("r <= 10")
    p = table(spark, d, PACK).select("query_id", F.col("id").alias("chunk_id"), F.lit(1).alias("hit"))
    return t.join(p, ["query_id", "chunk_id"], "left").groupBy("w").agg(F.round(F.avg(F.when(F.col("hit").isNotNull(), 1.0 / F.col("r")).otherwise(0.0)), 6).alias("mean_rr"))


_DIMS = [8, 16, 32]


@query(" UNION ALL ".join(
    f"""SELECT CAST({n} AS INT) AS dims, round(avg(CASE WHEN same THEN 1.0 ELSE 0.0 END), 6) AS precision FROM (SELECT q.label = e.label AS same, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({R._DOT.format(f'q.embedding[1:{n}]', f'e.embedding[1:{n}]')}, 6) DESC, e.vec_id) AS r
FROM embeddings q, embeddings e WHERE q.vec_id % {R.EVERY} = 0 AND q.vec_id <> e.vec_id) WHERE r <= 5""" for n in _DIMS))
def embedding_ablation(spark, d):
    """Precision at five by label for shorter vectors, all lengths in one plan."""
    e = table(spark, d, "embeddings", "vec_id", "embedding", "label")
    q = e.where(F.col("vec_id") % R.EVERY == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"), F.col("label").alias("ql"))
    s = None
    for n in _DIMS:  # the best six, of which one may be the query itself
        cut = lambda c, n=n: F.slice(c, 1, n)
        one = encoders.nearest(q.select("qid", cut("qv").alias("v")), e.select("vec_id", cut("embedding").alias("v")), "qid", "vec_id", 6, digits=6).withColumn("dims", F.lit(n))
        s = one if s is None else s.unionByName(one)
    t = s.where("vec_id <> qid").withColumn("r", F.row_number().over(Window.partitionBy("dims", "qid").orderBy(F.desc("score"), "vec_id"))).where("r <= 5")
    t = t.join(q.select("qid", "ql"), "qid").join(e.select("vec_id", "label"), "vec_id").withColumn("same", F.col("ql") == F.col("label"))
    return t.groupBy("dims").agg(F.round(F.avg(F.when(F.col("same"), 1.0).otherwise(0.0)), 6).alias("precision"))


@query(f"""WITH {E.METRICS} SELECT CASE WHEN qid >= 500000000 THEN 'heldout' ELSE 'main' END AS part, count(*) AS n, round(avg(ndcg), 6) AS ndcg, round(avg(recall), 6) AS recall, CAST(round(avg(rr), 6) AS DOUBLE) AS rr FROM m GROUP BY 1""")
def headline_metrics(spark, d):
    m = E._metrics(spark, d)
    return m.groupBy(F.when(F.col("qid") >= 500_000_000, "heldout").otherwise("main").alias("part")).agg(
        F.count("*").alias("n"), F.round(F.avg("ndcg"), 6).alias("ndcg"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("rr"), 6).alias("rr")
    )


# Nested sources


@query("SELECT row_id, CAST(len(list_filter(string_split(text, E'\\n'), lambda x: trim(x) <> '')) AS BIGINT) AS n FROM page_record WHERE text IS NOT NULL")
def layout_elements(spark, d):
    """Pages as nested layout JSON, read by an explicit schema and exploded to elements."""
    made = pages(spark, d).where("text is not null").select("row_id", F.to_json(F.struct("page", F.transform(F.split("text", "\n"), lambda x: F.struct(F.trim(x).alias("text"))).alias("texts"))).alias("j"))
    read = made.select("row_id", F.from_json("j", "page int, texts array<struct<text: string>>", {"mode": "FAILFAST"}).alias("doc"))
    elements = read.select("row_id", F.posexplode_outer("doc.texts").alias("pos", "e"))
    return elements.groupBy("row_id").agg(F.count_if(F.col("e.text") != "").alias("n"))


@query("SELECT source, count(*) AS docs FROM documents GROUP BY source")
def json_report(spark, d):
    """A report written as JSON and read back."""
    path = f"{ensure_checkpoint_dir(spark)}/report-{uuid.uuid4().hex}"
    write_report(table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("docs")), path)
    return read_jsonl(spark, path, "source string, docs bigint")


@query("""SELECT sample_id, CAST(length(text) AS BIGINT) AS n FROM question_sample2 WHERE text IS NOT NULL AND NOT contains(text, chr(96))""")
def parse_fenced_json(spark, d):
    """Replies that hold a JSON array inside a code fence: the fence is cut off, the array parsed."""
    q = table(spark, d, "question_sample2").where("text is not null").where(~F.col("text").contains("`"))
    reply = F.concat(F.lit("Here you are:\n```json\n"), F.to_json(F.array(F.struct("sample_id", "text"))), F.lit("\n```"))
    inner = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(\[.*\])\s*```", 1)
    parsed = F.from_json(inner, "array<struct<sample_id: bigint, text: string>>")
    return q.select(F.inline(parsed)).select("sample_id", F.length("text").cast("bigint").alias("n"))


@query()
def stream_cards(spark, d):
    """Events joined with a static table of cards while they stream."""
    static = spark.createDataFrame([("error", "Check the error"), ("purchase", "Thank the buyer")], "event_type string, card string")
    e = jobs.events(spark, d)
    return jobs.run_to_end(e.where("value > 40").join(F.broadcast(static), "event_type").select("user_id", "event_id", "card"))


SQL["stream_cards"] = "SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 'Check the error' ELSE 'Thank the buyer' END AS card FROM events WHERE value > 40 AND event_type IN ('error', 'purchase')"


# Caches, upserts and slots


@query(r"""WITH v AS (SELECT DISTINCT doc_id, lower(replace(x, ' ', '')) AS k, x FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)?(?: ?- ?[0-9]+(?:\.[0-9]+)?)? ?(?:mL/min/1\.73 m²|mg/mmol|mmol/L|mg/g|mmHg|g/L|mg|%|weeks|months|years|days)', 0)) AS x FROM documents))
SELECT doc_id, k AS key, min(x) AS spelling FROM v GROUP BY doc_id, k""")
def key_values(spark, d):
    """Values and ranges with units per document, one spelling of each."""
    pattern = r"[0-9]+(?:\.[0-9]+)?(?: ?- ?[0-9]+(?:\.[0-9]+)?)? ?(?:mL/min/1\.73 m²|mg/mmol|mmol/L|mg/g|mmHg|g/L|mg|%|weeks|months|years|days)"
    v = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("x"))
    return v.groupBy("doc_id", F.lower(F.replace("x", F.lit(" "), F.lit(""))).alias("key")).agg(F.min("x").alias("spelling"))


@query(f"""WITH c AS (SELECT substr(sha1(lower({SQUEEZE.format('query')})), 1, 16) AS qkey, min(id) AS cached FROM ckd_gold_eval WHERE query IS NOT NULL GROUP BY 1)
SELECT h.case_key, c.cached, c.cached IS NOT NULL AS hit FROM (SELECT case_key, substr(sha1(lower({SQUEEZE.format('query')})), 1, 16) AS qkey FROM heldout_chunkfirst WHERE query IS NOT NULL) h LEFT JOIN c USING (qkey)""")
def cache_lookup(spark, d):
    """Queries looked up by key in a cache of earlier ones; a miss stays null."""
    c = table(spark, d, "ckd_gold_eval").where("query is not null").groupBy(T.query_key(F.col("query")).alias("qkey")).agg(F.min("id").alias("cached"))
    h = table(spark, d, "heldout_chunkfirst").where("query is not null").select("case_key", T.query_key(F.col("query")).alias("qkey"))
    return h.join(c, "qkey", "left").select("case_key", "cached", F.col("cached").isNotNull().alias("hit"))


@query("""WITH u AS (SELECT c_custkey AS k, c_acctbal AS v, 0 AS run FROM customer UNION ALL SELECT o_custkey, max(o_totalprice), 1 FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey) SELECT k, arg_max(v, run) AS v, CAST(max(run) AS INT) AS run FROM u GROUP BY k""")
def upsert(spark, d):
    """A new run's rows replace those of the same key, all others stay."""
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.lit(0).alias("run"))
    new = table(spark, d, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v")).withColumn("run", F.lit(1))
    return old.unionByName(new).groupBy("k").agg(F.max(F.struct("run", "v")).alias("m")).select("k", "m.v", "m.run")


@query(f"""WITH r AS (SELECT query_id, id, rank, contains(id, '_table_row_') AS tab FROM {PACK}), f AS (SELECT query_id, min(rank) AS first FROM r WHERE tab GROUP BY query_id),
s AS (SELECT r.query_id, r.id, CASE WHEN tab AND r.rank = first AND r.rank > 3 THEN 2.5 WHEN r.rank <= 3 OR NOT tab OR r.rank <> first THEN CAST(r.rank AS DOUBLE) ELSE r.rank END AS place FROM r LEFT JOIN f USING (query_id))
SELECT query_id, id, CAST(slot AS INT) AS slot FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY place, id) AS slot FROM s) WHERE slot <= 3""")
def reserved_slot(spark, d):
    """The first table row of a pack is kept in its first three, at the last place, if it ranks below."""
    r = table(spark, d, PACK).select("query_id", "id", "rank", F.col("id").contains("_table_row_").alias("tab"))
    f = r.where("tab").groupBy("query_id").agg(F.min("rank").alias("first"))
    place = F.when(F.col("tab") & (F.col("rank") == F.col("first")) & (F.col("rank") > 3), 2.5).otherwise(F.col("rank").cast("double"))
    w = Window.partitionBy("query_id").orderBy("place", "id")
    return r.join(f, "query_id", "left").select("query_id", "id", place.alias("place")).withColumn("slot", F.row_number().over(w)).where("slot <= 3").select("query_id", "id", "slot")


_OUTSIDE = [("contents", "table of contents"), ("references", "doi:"), ("rights", "all rights reserved")]


@query("SELECT row_id FROM page_record p WHERE text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM (VALUES " + ", ".join(f"('{n}', '{p}')" for n, p in _OUTSIDE) + ") o(name, pattern) WHERE contains(lower(p.text), o.pattern))")
def inside_guidance(spark, d):
    """Pages that match none of a denylist of sections; the list is constants, so no join is needed."""
    low = F.lower("text")
    bad = F.lit(False)
    for _, p in _OUTSIDE:
        bad = bad | low.contains(p)
    return pages(spark, d).where(F.col("text").isNotNull() & ~bad).select("row_id")


@query("""WITH o AS (SELECT user_id, event_type AS code, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) SELECT user_id, code, value FROM o WHERE rn = 1 AND code IN ('purchase', 'error')""")
def read_facts(spark, d):
    """Nested bundles of observations per user: exploded, filtered by code, the first value of a code wins."""
    e = table(spark, d, "events").select("user_id", F.to_json(F.struct(F.col("event_type").alias("code"), "value", F.col("ts").cast("string").alias("at"), F.col("event_id").alias("no"))).alias("entry"))
    entry = e.select("user_id", F.from_json("entry", "code string, value double, at string, no bigint").alias("x")).where("x.code in ('purchase', 'error')")
    first = entry.groupBy("user_id", "x.code").agg(F.min(F.struct(F.col("x.at").cast("timestamp_ntz").alias("at"), F.col("x.no").alias("no"), F.col("x.value").alias("value"))).alias("m"))
    return first.select("user_id", "code", "m.value")
