"""The pN_ queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from tarnwell.llm import lookalike, neardup, overlap, packing, pages, ranking, sentences, split, tokens
from tarnwell.llm.texts import EVIDENCE, PAGES, QUESTIONS, items
from tarnwell.sources import table

#: problem 3: the scores and their weights
SCORES = {"tfidf": 1.0, "dense": 1.0, "pack": 1.0}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return split.oversized(items(spark, d, PAGES, EVIDENCE))


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_oversized(items(spark, d, PAGES, EVIDENCE))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    texts = items(spark, d, PAGES, EVIDENCE)
    return lookalike.show_alike(texts, lookalike.rules_for(texts))


def p2_canonical(spark: SparkSession, d: str) -> DataFrame:
    texts = items(spark, d, PAGES, EVIDENCE)
    return lookalike.canonical(texts, lookalike.rules_for(texts)).select("src", "id", "canonical")


def _median_ranks(spark: SparkSession, d: str, positions: bool = False) -> DataFrame:
    """Ranks over all chunks that index_score lists; the pack's scores are another signal of them."""
    listed = table(spark, d, "index_score", "query_id", "chunk_id", "tfidf", "dense")
    pack = table(spark, d, EVIDENCE).select("query_id", F.col("id").alias("chunk_id"), F.col("score").alias("pack"))
    null = F.lit(None).cast("double")
    rows = listed.withColumn("pack", null).unionByName(pack.select("query_id", "chunk_id", null.alias("tfidf"), null.alias("dense"), "pack"))
    return ranking.median_ranks(rows, "query_id", "chunk_id", SCORES, positions)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return ranking.first_of(_median_ranks(spark, d), "query_id", "chunk_id", len(SCORES))


def p3_ranking(spark: SparkSession, d: str) -> DataFrame:
    return _median_ranks(spark, d, positions=True).withColumn("mean_rank", F.round("mean_rank", 6))


def _splits(spark: SparkSession, d: str) -> DataFrame:
    """Queries by split: `dev` trains; `test` of the main table and all held-out rows evaluate."""
    own = F.regexp_replace(F.lower("slice"), r"(?U)^\s+|\s+$", "")
    gold, held = "ckd_gold_eval", "heldout_chunkfirst"
    a = table(spark, d, gold).select(own.alias("slice"), F.lit(gold).alias("source"), F.col("case_key").alias("key"), F.col("query").alias("text"))
    b = table(spark, d, held).select(F.lit("heldout").alias("slice"), F.lit(held).alias("source"), F.col("case_key").alias("key"), F.col("query").alias("text"))
    return a.where(F.col("slice").isin("dev", "test")).unionByName(b)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = overlap.overlaps(_splits(spark, d))
    return pairs.select("slice", F.least("eval_key", "train_key").alias("key_a"), F.greatest("eval_key", "train_key").alias("key_b"))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.report(_splits(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_pairs(items(spark, d, EVIDENCE, QUESTIONS), words=1, threshold=0.7, weights="unit")


_FIELDS = ["text", "pymupdf_text", "pdfplumber_text"]


def _page_tables(spark: SparkSession, d: str) -> tuple[DataFrame, list[str], dict[str, int], pages.Forms]:
    rows = table(spark, d, PAGES, "row_id", "document_id", "title", "page", *_FIELDS)
    # publisher_ref doesn't grow; it names the publishers that running lines show
    names = frozenset(n.strip().casefold() for r in table(spark, d, "publisher_ref").collect() for n in (r.publisher_name, r.publisher) if n and n.strip())
    return rows, _FIELDS, *pages.learn(rows, _FIELDS, names)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return pages.notes(*_page_tables(spark, d))


def p7_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return pages.repair(*_page_tables(spark, d))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per document: its class of near-duplicates and the number of its links."""
    return neardup.near_groups(items(spark, d, EVIDENCE, QUESTIONS), words=1, threshold=0.7, weights="unit")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    capacity = packing.TOKENS
    return packing.pack(tokens.lengths(table(spark, d, "documents")), attention=int(packing.ATTENTION * capacity * capacity))


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are."""
    return packing.fill(p9_containers(spark, d))


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text")
    return sentences.split(docs, sentences.learn(docs))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _sentences(spark, d).select("doc_id", "end_pos")


def p10_sentences(spark: SparkSession, d: str) -> DataFrame:
    return _sentences(spark, d)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1].isdigit() and callable(f)}


_SPACES = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

_P1 = f"""WITH t AS (SELECT 'page_record' AS src, row_id, text FROM page_record UNION ALL SELECT 'pregnancy_scope_evidence_pack', ev_id, raw_text FROM pregnancy_scope_evidence_pack)
SELECT src, row_id, CASE WHEN list_max(list_transform(string_split_regex(text, '[{_SPACES}.!?。！？]'), lambda x: length(x))) > 2000 THEN 'forced' ELSE 'boundary' END AS kind FROM t WHERE length(text) > 2000"""

_P3 = """WITH a AS (SELECT query_id, chunk_id, tfidf, dense, CAST(NULL AS DOUBLE) AS pack FROM index_score UNION ALL SELECT query_id, id, NULL, NULL, score FROM pregnancy_scope_evidence_pack),
o AS (SELECT query_id, chunk_id, max(tfidf) AS s0, max(dense) AS s1, max(pack) AS s2 FROM a GROUP BY ALL),
r AS (SELECT query_id, chunk_id, (s0 IS NOT NULL)::INT + (s1 IS NOT NULL)::INT + (s2 IS NOT NULL)::INT AS n, CASE WHEN s0 IS NULL THEN count(s0) OVER g + 1 ELSE rank() OVER (PARTITION BY query_id ORDER BY s0 DESC NULLS LAST) END AS r0,
 CASE WHEN s1 IS NULL THEN count(s1) OVER g + 1 ELSE rank() OVER (PARTITION BY query_id ORDER BY s1 DESC NULLS LAST) END AS r1, CASE WHEN s2 IS NULL THEN count(s2) OVER g + 1 ELSE rank() OVER (PARTITION BY query_id ORDER BY s2 DESC NULLS LAST) END AS r2 FROM o WINDOW g AS (PARTITION BY query_id)),
m AS (SELECT query_id, chunk_id, n, CAST(list_sort([r0, r1, r2])[2] AS DOUBLE) AS median_rank, (r0 + r1 + r2) / 3.0 AS mean_rank FROM r)"""

_P4 = """WITH w AS (SELECT case_key AS k, regexp_replace(lower(slice), '^\\s+|\\s+$', '', 'g') AS slice, list_distinct(regexp_extract_all(lower(query), '[\\p{L}\\p{N}]+', 0)) AS w FROM ckd_gold_eval WHERE query IS NOT NULL
 UNION ALL SELECT case_key, 'heldout', list_distinct(regexp_extract_all(lower(query), '[\\p{L}\\p{N}]+', 0)) FROM heldout_chunkfirst WHERE query IS NOT NULL),
p AS (SELECT e.slice, e.k AS ek, t.k AS tk, len(list_intersect(e.w, t.w)) AS i, len(e.w) + len(t.w) AS n FROM w e JOIN w t ON t.slice = 'dev' AND e.slice IN ('test', 'heldout') AND len(e.w) > 0 AND len(t.w) > 0)
SELECT slice, least(ek, tk) AS key_a, greatest(ek, tk) AS key_b FROM p WHERE i >= 0.7 * (n - i) - 1e-9"""


_P4_REPORT = _P4.replace("SELECT slice, least(ek, tk)", "SELECT slice, least(ek, tk)").rsplit("SELECT slice", 1)[0].rstrip() + """,
s AS (SELECT case_key AS k, regexp_replace(lower(slice), '^\\s+|\\s+$', '', 'g') AS slice, 'ckd_gold_eval' AS source, regexp_extract_all(lower(query), '[\\p{L}\\p{N}]+', 0) AS w FROM ckd_gold_eval WHERE query IS NOT NULL
 UNION ALL SELECT case_key, 'heldout', 'heldout_chunkfirst', regexp_extract_all(lower(query), '[\\p{L}\\p{N}]+', 0) FROM heldout_chunkfirst WHERE query IS NOT NULL),
e AS (SELECT *, len(w) AS n, array_to_string(w, ' ') AS t FROM s WHERE slice IN ('test', 'heldout') AND len(w) > 0), t AS (SELECT w, len(w) AS n, array_to_string(w, ' ') AS t FROM s WHERE slice = 'dev' AND len(w) > 0),
er AS (SELECT k, i, array_to_string(w[i:i + 4], ' ') AS run FROM (SELECT k, w, unnest(range(1, n - 3)) AS i FROM e WHERE n >= 5)), tr AS (SELECT DISTINCT array_to_string(w[i:i + 4], ' ') AS run FROM (SELECT w, unnest(range(1, n - 3)) AS i FROM t WHERE n >= 5)),
c AS (SELECT k, count(DISTINCT i + o) AS covered FROM er JOIN tr USING (run), range(5) r(o) GROUP BY k), x AS (SELECT ek AS k, max((i >= n - i)::INT) AS exact FROM p WHERE i >= 0.7 * (n - i) - 1e-9 GROUP BY ek)
SELECT slice, source, count(*) AS records, count(exact) AS overlapping, CAST(coalesce(sum(exact), 0) AS BIGINT) AS exact, round(avg(CASE WHEN n < 5 THEN (e.t IN (SELECT t FROM t))::INT::DOUBLE ELSE coalesce(covered, 0)::DOUBLE / n END), 6) AS mean_coverage
FROM e LEFT JOIN x USING (k) LEFT JOIN c USING (k) GROUP BY slice, source"""


def _shown_sql(text: str) -> str:
    """The consistent form of a text in SQL: the fixed classes written out, accents composed before and after."""
    import unicodedata

    looks = set("".join(lookalike.LOOKS)) | set("".join(lookalike.LOOKS.values()))
    every = [chr(c) for c in range(0xA0, 0x10000) if not 0xD800 <= c < 0xE000]
    kept = {c for c in every if c in looks or lookalike._plain(c) or c.isspace() or unicodedata.category(c) in lookalike.INVISIBLE or unicodedata.normalize("NFD", c)[0] in looks}
    ascii_ = {chr(c) for c in range(0x20, 0x7F)} | {"\t", "\n", "\r"}
    rules = {s: r for s, r in lookalike.build_rules(lookalike.usual_counts(ascii_ | kept)).items() if len(s) == 1}
    one = {s: r for s, r in rules.items() if len(r) == 1}
    gone = [s for s, r in rules.items() if not r]
    quote = lambda t: t.replace("'", "''")
    out = f"nfc_normalize({text})"
    for s, r in rules.items():
        if len(r) > 1:
            out = f"replace({out}, '{quote(s)}', '{quote(r)}')"
    return f"nfc_normalize(translate({out}, '{quote(''.join([*one, *gone]))}', '{quote(''.join(one.values()))}'))"


def _p2_sql() -> str:
    return f"""WITH t AS (SELECT 'page_record' AS src, row_id AS id, text FROM page_record UNION ALL SELECT 'pregnancy_scope_evidence_pack', ev_id, raw_text FROM pregnancy_scope_evidence_pack), s AS (SELECT src, id, text, {_shown_sql('text')} AS shown FROM t WHERE text IS NOT NULL)
SELECT a.src, a.id AS id_a, b.id AS id_b FROM s a JOIN s b ON a.src = b.src AND a.shown = b.shown AND a.id < b.id AND a.text <> b.text WHERE trim(a.shown, ' ' || chr(9) || chr(10) || chr(13)) <> ''"""


def _p5_sql() -> str:
    return f"""WITH t AS (SELECT 'pregnancy_scope_evidence_pack' AS src, ev_id AS id, raw_text AS text FROM pregnancy_scope_evidence_pack UNION ALL SELECT 'question_sample2', sample_id, text FROM question_sample2),
w AS (SELECT src, id, list_distinct(regexp_extract_all(lower({_shown_sql('text')}), '[\\p{{L}}\\p{{N}}]+', 0)) AS w FROM t WHERE text IS NOT NULL),
p AS (SELECT a.src, a.id AS id_a, b.id AS id_b, len(list_intersect(a.w, b.w)) AS i, len(a.w) + len(b.w) AS n FROM w a JOIN w b ON a.src = b.src AND a.id < b.id AND len(a.w) > 0 AND len(b.w) > 0 AND least(len(a.w), len(b.w)) >= 0.7 * greatest(len(a.w), len(b.w)) - 1e-9)
SELECT src, id_a, id_b FROM p WHERE i >= 0.7 * (n - i) - 1e-9"""


def oracle_sql() -> dict[str, str]:
    best = _P3 + " SELECT query_id, arg_min(chunk_id, (median_rank, mean_rank, chunk_id)) AS chunk_id FROM m WHERE n = 3 GROUP BY query_id"
    ranking = _P3 + """ SELECT query_id, chunk_id, median_rank, round(mean_rank, 6) AS mean_rank, CAST(n AS BIGINT) AS n_scores, row_number() OVER (PARTITION BY query_id ORDER BY median_rank, mean_rank, chunk_id) AS position FROM m"""
    return {"p1_found": _P1, "p2_found": _p2_sql(), "p3_found": best, "p3_ranking": ranking, "p4_found": _P4, "p4_report": _P4_REPORT, "p5_found": _p5_sql()}
