"""Queries of the text functions, quality predicates and segmentation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tarnwell.functions import lexicon as L, text as T
from tarnwell.sources import latest_by_key as latest, table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "page_record")


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


TOK = r"regexp_extract_all(lower(text), '[a-z0-9]+(?:\.[a-z0-9]+)?|[<>]=?', 0)"
SQUEEZE = r"trim(regexp_replace({0}, '[\s\x{{00a0}}]+', ' ', 'g'))"


@query(r"""SELECT row_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(text, chr(160), ' '), '-\n([a-z])', '\1', 'g'),
  '[ \t]+', ' ', 'g'), '\n{3,}', E'\n\n', 'g'), '^\s+|\s+$', '', 'g') AS normal FROM page_record WHERE text IS NOT NULL""")
def page_normalize(spark, d):
    return pages(spark, d).where("text is not null").select("row_id", T.page_normalize(F.col("text")).alias("normal"))


def _nested(expr: str, pairs: dict) -> str:
    for a, b in pairs.items():
        expr = "replace({0}, '{1}', '{2}')".format(expr, a.replace("'", "''"), b.replace("'", "''"))
    return expr


@query("SELECT doc_id, md5(" + SQUEEZE.format(r"regexp_replace(" + _nested("text", L.SYMBOLS) + r", '\bm 2\b', 'm2', 'g')") + ") AS normal_md5 FROM documents WHERE text IS NOT NULL")
def chunk_normalize(spark, d):
    return docs(spark, d).where("text is not null").select("doc_id", F.md5(T.chunk_normalize(F.col("text"), L.SYMBOLS)).alias("normal_md5"))


_SCORE = "len(list_filter(regexp_extract_all(lower({0}), '[a-z]{{3,}}', 0), lambda w: w IN (" + quoted(L.COMMON_WORDS) + ")))"


_MIRROR = "array_to_string(list_reverse(string_split({0}, '')), '')"  # by characters, not by what shows as one


@query(f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN {_MIRROR.format('text')} ELSE text END AS t FROM documents WHERE text IS NOT NULL), m AS (SELECT *, {_MIRROR.format('t')} AS m FROM d)
SELECT doc_id, md5(CASE WHEN length(t) >= 12 AND {_SCORE.format('m')} > {_SCORE.format('t')} THEN m ELSE t END) AS repaired_md5 FROM m""")
def mirror_repair(spark, d):
    t = docs(spark, d).where("text is not null")
    t = t.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.reverse("text")).otherwise(F.col("text")).alias("t"))
    return t.select("doc_id", F.md5(T.mirror_repair(F.col("t"), L.COMMON_WORDS)).alias("repaired_md5"))


@query(f"SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({TOK}) AS token FROM documents) GROUP BY token")
def tokenize(spark, d):
    t = docs(spark, d).select("doc_id", F.explode(T.tokens(F.col("text"))).alias("token"))
    per_doc = t.groupBy("token", "doc_id").agg(F.count("*").alias("n"))
    return per_doc.groupBy("token").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


@query(f"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter({TOK}, lambda w: length(w) > 2 AND w NOT IN ({quoted(T.STOPWORDS)})))), ' ') AS terms
FROM documents WHERE text IS NOT NULL""")
def content_terms(spark, d):
    return docs(spark, d).where("text is not null").select("doc_id", F.array_join(T.content_terms(F.col("text")), " ").alias("terms"))


@query("""WITH f AS (SELECT doc_id, substr(regexp_replace(lower(text), '[^a-z0-9]', '', 'g'), 1, 160) AS fp FROM documents WHERE text IS NOT NULL)
SELECT fp, min(doc_id) AS first_id, count(*) AS copies FROM f WHERE fp <> '' GROUP BY fp HAVING count(*) > 1""")
def fingerprint_dups(spark, d):
    f = docs(spark, d).where("text is not null").select("doc_id", T.fingerprint(F.col("text"), 160).alias("fp")).where("fp <> ''")
    return f.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")


#: length of the common beginning of {a} and {b}, in SQL: the first place where their characters differ
PREFIX = """CASE WHEN least(length({a}), length({b})) = 0 THEN CAST(0 AS BIGINT) ELSE CAST(coalesce(nullif(list_position(list_transform(list_zip(string_split({a}, '')[1:least(length({a}), length({b}))], string_split({b}, '')[1:least(length({a}), length({b}))]), lambda z: z[1] = z[2]), false), 0), least(length({a}), length({b})) + 1) - 1 AS BIGINT) END"""


@query(f"SELECT row_id, {PREFIX.format(a='text', b='pymupdf_text')} AS prefix FROM page_record WHERE text IS NOT NULL AND pymupdf_text IS NOT NULL")
def common_prefix(spark, d):
    p = pages(spark, d).where("text is not null and pymupdf_text is not null")
    return p.select("row_id", T.common_prefix(F.col("text"), F.col("pymupdf_text")).cast("bigint").alias("prefix"))


@query("""WITH s AS (SELECT row_id, trim(regexp_replace(lower(title), '[^a-z0-9]+', '_', 'g'), '_') AS s FROM page_record)
SELECT row_id, CASE WHEN length(s) > 0 THEN substr(s, 1, 60) ELSE 'chunk' END AS slug FROM s""")
def slug(spark, d):
    return pages(spark, d).select("row_id", T.slug(F.col("title")).alias("slug"))


_WORDS = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+', 0))"


@query(f"""WITH p AS (SELECT row_id, {_WORDS.format("coalesce(pymupdf_text, '')")} AS a, {_WORDS.format("coalesce(pdfplumber_text, '')")} AS b FROM page_record),
q AS (SELECT row_id, len(list_intersect(a, b)) AS i, len(a) + len(b) - len(list_intersect(a, b)) AS u FROM p)
SELECT row_id, CASE WHEN u = 0 THEN 1.0 ELSE round(CAST(i AS DOUBLE) / u, 6) END AS agreement FROM q""")
def jaccard_pairs(spark, d):
    a, b = (F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))) for c in ("pymupdf_text", "pdfplumber_text"))
    p = pages(spark, d).select("row_id", a.alias("a"), b.alias("b"))
    return p.select("row_id", F.round(T.jaccard(F.col("a"), F.col("b")), 6).alias("agreement"))


@query("""SELECT row_id, array_to_string(list_filter([CASE WHEN length(coalesce(pymupdf_text, '')) < 100 AND length(coalesce(pdfplumber_text, '')) < 100 THEN 'little_text' END,
  CASE WHEN parser_agreement < 0.55 THEN 'parsers_differ' END, CASE WHEN regexp_matches(text, '[<>≤≥] ?[0-9]') THEN 'thresholds' END,
  CASE WHEN contains(text, '|') OR contains(text, 'Table') THEN 'table' END], lambda x: x IS NOT NULL), ',') AS flags FROM page_record""")
def page_flags(spark, d):
    text = F.col("text")
    flags = F.array(
        F.when((F.length(F.coalesce("pymupdf_text", F.lit(""))) < 100) & (F.length(F.coalesce("pdfplumber_text", F.lit(""))) < 100), "little_text"),
        F.when(F.col("parser_agreement") < 0.55, "parsers_differ"),
        F.when(text.rlike("[<>≤≥] ?[0-9]"), "thresholds"),
        F.when(text.contains("|") | text.contains("Table"), "table"),
    )
    return pages(spark, d).select("row_id", F.array_join(F.filter(flags, lambda x: x.isNotNull()), ",").alias("flags"))


@query("""SELECT row_id, CASE WHEN length(pymupdf_text) >= length(pdfplumber_text) * 0.75 THEN 'pymupdf' ELSE 'pdfplumber' END AS extractor,
  CAST(length(CASE WHEN length(pymupdf_text) >= length(pdfplumber_text) * 0.75 THEN pymupdf_text ELSE pdfplumber_text END) AS BIGINT) AS n_chars
FROM page_record WHERE pymupdf_text IS NOT NULL AND pdfplumber_text IS NOT NULL""")
def primary_extractor(spark, d):
    first = F.length("pymupdf_text") >= F.length("pdfplumber_text") * 0.75
    p = pages(spark, d).where("pymupdf_text is not null and pdfplumber_text is not null")
    return p.select("row_id", F.when(first, "pymupdf").otherwise("pdfplumber").alias("extractor"), F.when(first, F.length("pymupdf_text")).otherwise(F.length("pdfplumber_text")).cast("bigint").alias("n_chars"))


@query(r"""SELECT doc_id, CAST(len(list_filter(string_split(text, E'\n'), lambda x: length(trim(x)) > 0)) AS BIGINT) AS n_lines,
  CAST(len(regexp_extract_all(text, '[^ \t\n\r\f\x0b]+', 0)) AS BIGINT) AS n_words FROM documents WHERE text IS NOT NULL""")
def line_word_counts(spark, d):
    t = F.col("text")
    return docs(spark, d).where("text is not null").select("doc_id", T.line_count(t).cast("bigint").alias("n_lines"), T.word_count(t).cast("bigint").alias("n_words"))


_TAGS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN '{n}' END" for n, p in L.TOPICS.items()) + "], lambda x: x IS NOT NULL)"


@query(f"SELECT sample_id, CASE WHEN len({_TAGS}) = 0 THEN 'general' ELSE array_to_string({_TAGS}, ',') END AS topics FROM question_sample2 WHERE text IS NOT NULL")
def topic_tags(spark, d):
    q = table(spark, d, "question_sample2").where("text is not null")
    return q.select("sample_id", F.array_join(T.tags(F.col("text"), L.TOPICS, "general"), ",").alias("topics"))


_EXACT = r"(?:eGFR|ferritin|potassium|haemoglobin|creatinine|albumin)[a-z -]{0,20} (?:above|below|to|exceeds) [0-9]+(?:\.[0-9]+)?"


@query(f"""SELECT sample_id, array_to_string(list_slice(list_sort(list_distinct(regexp_extract_all(text, '{_EXACT}', 0))), 1, 12), '; ') AS terms
FROM question_sample2 WHERE text IS NOT NULL""")
def exact_terms(spark, d):
    q = table(spark, d, "question_sample2").where("text is not null")
    found = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(_EXACT), F.lit(0))))
    return q.select("sample_id", F.array_join(F.slice(found, 1, 12), "; ").alias("terms"))


@query(f"""WITH t AS (SELECT sample_id, CASE WHEN len({_TAGS}) = 0 THEN ['general'] ELSE {_TAGS} END AS topics, chunk_type FROM question_sample2 WHERE text IS NOT NULL)
SELECT sample_id, array_to_string(list_slice(list_distinct_ordered, 1, 6), ' ') AS questions FROM (
 SELECT sample_id, list_concat(CASE WHEN chunk_type IS NULL THEN [] ELSE ['What does this ' || replace(chunk_type, '_', ' ') || ' say?'] END,
   list_transform(topics, lambda x: 'What is advised about ' || replace(x, '_', ' ') || '?')) AS list_distinct_ordered FROM t)""")
def template_questions(spark, d):
    q = table(spark, d, "question_sample2").where("text is not null")
    label = F.when(F.col("chunk_type").isNotNull(), F.array(F.concat(F.lit("What does this "), F.replace("chunk_type", F.lit("_"), F.lit(" ")), F.lit(" say?")))).otherwise(F.array().cast("array<string>"))
    by_topic = F.transform(T.tags(F.col("text"), L.TOPICS, "general"), lambda x: F.concat(F.lit("What is advised about "), F.replace(x, F.lit("_"), F.lit(" ")), F.lit("?")))
    return q.select("sample_id", F.array_join(F.slice(F.array_distinct(F.concat(label, by_topic)), 1, 6), " ").alias("questions"))


@query(f"""SELECT doc_id, CASE WHEN len({TOK}) = 0 THEN 0.0 ELSE round(CAST(len(list_filter({TOK}, lambda x: regexp_matches(x, '^[0-9]'))) AS DOUBLE) / len({TOK}), 6) END AS share
FROM documents WHERE text IS NOT NULL""")
def numeric_share(spark, d):
    return docs(spark, d).where("text is not null").select("doc_id", F.round(T.numeric_share(F.col("text")), 6).alias("share"))


LINES_SQL = r"""lines AS (SELECT doc_id, i AS line_no, trim(ls[i]) AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i
  FROM (SELECT doc_id, string_split(text, E'\n') AS ls FROM documents WHERE text IS NOT NULL)))"""


def lines(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, line_no, line) of every document, blank lines too."""
    split = docs(spark, d).where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return split.select("doc_id", (F.col("pos") + 1).cast("bigint").alias("line_no"), F.trim("line").alias("line"))


_LEVEL = r"""CASE WHEN regexp_matches(line, '^(Chapter|Appendix)\b') THEN 0 WHEN regexp_matches(line, '^[0-9]+\.[0-9]+\.[0-9]+') THEN 2 WHEN regexp_matches(line, '^[0-9]+\.[0-9]+') THEN 1
 WHEN upper(line) = line AND length(line) > 8 THEN 0 ELSE 2 END"""
_IS_HEADING = r"regexp_matches(line, '^([0-9]+\.[0-9]+ |Chapter |Appendix )') AND length(line) < 80"


def headings(ls: DataFrame) -> DataFrame:
    h = ls.where(F.col("line").rlike(r"^([0-9]+\.[0-9]+ |Chapter |Appendix )") & (F.length("line") < 80))
    return h.withColumn("level", T.heading_level(F.col("line")))


@query(f"WITH {LINES_SQL} SELECT doc_id, line_no, line, {_LEVEL} AS level FROM lines WHERE {_IS_HEADING}")
def heading_level(spark, d):
    return headings(lines(spark, d))


_SPELLED = r"\b(?:(?:" + "|".join(w for w, v in T.SPELLED.items() if v >= 20) + ")(?:[ -](?:" + "|".join(w for w, v in T.SPELLED.items() if 0 < v < 10) + "))?|" + "|".join(sorted((w for w, v in T.SPELLED.items() if v < 20), key=len, reverse=True)) + r")\b"


@query(f"""WITH n(w, v) AS (VALUES {", ".join(f"('{w}', {v})" for w, v in T.SPELLED.items())}), m AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(lower(text), '{T.BEYOND}', '_', 'g'), '{_SPELLED}', 0)) AS m FROM documents WHERE text IS NOT NULL),
i AS (SELECT doc_id, m, row_number() OVER () AS i FROM m), s AS (SELECT doc_id, i, unnest(regexp_split_to_array(m, '[ -]')) AS part FROM i)
SELECT d.doc_id, count(DISTINCT i) AS n, coalesce(CAST(sum(v) AS DOUBLE), 0) AS total FROM documents d LEFT JOIN (s JOIN n ON n.w = s.part) x ON x.doc_id = d.doc_id WHERE text IS NOT NULL GROUP BY d.doc_id""")
def spelled_numbers(spark, d):
    v = T.spelled_numbers(F.col("text"))
    return docs(spark, d).where("text is not null").select("doc_id", v.alias("v")).select("doc_id", F.size("v").cast("bigint").alias("n"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query(f"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)? ?(?:{T.UNITS})', 0), lambda x: lower(replace(x, ' ', ''))))), '; ') AS stated
FROM documents WHERE text IS NOT NULL""")
def stated_values(spark, d):
    return docs(spark, d).where("text is not null").select("doc_id", F.array_join(T.stated_values(F.col("text")), "; ").alias("stated"))


@query("SELECT case_key, substr(sha1(lower(" + SQUEEZE.format("query") + ")), 1, 16) AS qkey FROM heldout_chunkfirst WHERE query IS NOT NULL")
def query_key(spark, d):
    return table(spark, d, "heldout_chunkfirst").where("query is not null").select("case_key", T.query_key(F.col("query")).alias("qkey"))


@query("SELECT doc_id, substr(" + SQUEEZE.format("text") + ", 1, 240) AS snippet FROM documents WHERE text IS NOT NULL")
def snippet(spark, d):
    return docs(spark, d).where("text is not null").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


@query("SELECT doc_id, sha256(text) AS sha FROM documents WHERE text IS NOT NULL")
def sha256_fingerprint(spark, d):
    return docs(spark, d).where("text is not null").select("doc_id", F.sha2("text", 256).alias("sha"))


@query("""WITH r AS (SELECT user_id, event_id, props, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN length(trim(props)) > 0 THEN 1 ELSE 0 END DESC, event_id DESC) AS rn FROM events)
SELECT user_id, event_id, props FROM r WHERE rn = 1""")
def latest_by_key(spark, d):
    return latest(table(spark, d, "events"), "user_id", "event_id", "props")


@query(r"""WITH g AS (SELECT sample_id, list_transform(string_split(text, '. '), lambda s: string_split(s, ',')) AS g FROM question_sample2 WHERE text IS NOT NULL AND text <> '')
SELECT sample_id, CAST(len(g) AS BIGINT) AS n_rows, CAST(list_max(list_transform(g, lambda r: len(r))) AS BIGINT) AS n_columns,
 CAST(list_sum(list_transform(g, lambda r: list_max(list_transform(g, lambda q: len(q))) - len(r))) AS BIGINT) AS padded FROM g""")
def pad_ragged(spark, d):
    q = table(spark, d, "question_sample2").where("text is not null and text <> ''")
    grid = q.select("sample_id", F.transform(F.split("text", r"\. "), lambda s: F.split(s, ",")).alias("g"))
    wide = grid.select("sample_id", "g", F.array_max(F.transform("g", F.size)).alias("w"))
    full = wide.select("sample_id", "w", F.transform("g", lambda r: F.concat(r, F.array_repeat(F.lit(""), F.col("w") - F.size(r)))).alias("full"), F.transform("g", F.size).alias("had"))
    padded = F.aggregate(F.arrays_zip("full", "had"), F.lit(0), lambda a, x: a + F.size(x["full"]) - x["had"])
    return full.select("sample_id", F.size("full").cast("bigint").alias("n_rows"), F.col("w").cast("bigint").alias("n_columns"), padded.cast("bigint").alias("padded"))


# Quality predicates and audits


@query(f"""SELECT sample_id, array_to_string(list_filter([CASE WHEN length(text) < CASE WHEN chunk_type = 'section_passage' THEN 90 ELSE 25 END THEN 'too_short' END,
 CASE WHEN len({TOK}) >= 3 AND len(list_filter(list_distinct({TOK}), lambda x: regexp_matches(x, '^[0-9]'))) >= 0.7 * len(list_distinct({TOK})) THEN 'numbers_only' END,
 CASE WHEN regexp_matches(text, '[a-z]-$') THEN 'cut_off' END, CASE WHEN NOT regexp_matches(text, '[.!?]$') THEN 'unterminated' END], lambda x: x IS NOT NULL), ',') AS flags
FROM question_sample2 WHERE text IS NOT NULL""")
def quality_flags(spark, d):
    t = F.col("text")
    words = T.tokens(t)
    distinct = F.array_distinct(words)
    flags = F.array(
        F.when(F.length(t) < F.when(F.col("chunk_type") == "section_passage", 90).otherwise(25), "too_short"),
        F.when((F.size(words) >= 3) & (F.size(F.filter(distinct, lambda x: x.rlike("^[0-9]"))) >= 0.7 * F.size(distinct)), "numbers_only"),
        F.when(t.rlike("[a-z]-$"), "cut_off"),
        F.when(~t.rlike("[.!?]$"), "unterminated"),
    )
    return table(spark, d, "question_sample2").where("text is not null").select("sample_id", F.array_join(F.filter(flags, lambda x: x.isNotNull()), ",").alias("flags"))


_PENALTY = r"round((CASE WHEN regexp_matches(lower(raw_text), 'doi:|et al\.') THEN 0.55 ELSE 1.0 END) * (CASE WHEN contains(lower(id), 'reference') THEN 0.65 ELSE 1.0 END) * (CASE WHEN citation IS NULL THEN 0.90 ELSE 1.0 END), 6)"


@query(f"SELECT ev_id, CAST({_PENALTY} AS DOUBLE) AS penalty FROM pregnancy_scope_evidence_pack")
def quality_penalty(spark, d):
    def factor(test, x):
        return F.when(test, x).otherwise(1.0)

    p = factor(F.lower("raw_text").rlike(r"doi:|et al\."), 0.55) * factor(F.lower("id").contains("reference"), 0.65) * factor(F.col("citation").isNull(), 0.90)
    return table(spark, d, "pregnancy_scope_evidence_pack").select("ev_id", F.round(p, 6).alias("penalty"))


@query("SELECT rule, n FROM (SELECT " + ", ".join(f"CAST(count(*) FILTER (regexp_matches(text, '(?i){p}')) AS BIGINT) AS {n}" for n, p in L.APPARATUS.items()) + ") AS x UNPIVOT (n FOR rule IN (" + ", ".join(L.APPARATUS) + "))")
def hygiene(spark, d):
    one = docs(spark, d).agg(*[F.count_if(F.col("text").rlike(f"(?i){p}")).alias(n) for n, p in L.APPARATUS.items()])
    return one.unpivot([], list(L.APPARATUS), "rule", "n")


SQL["hygiene"] = "WITH c AS (SELECT " + ", ".join(f"count(*) FILTER (regexp_matches(text, '(?i){p}')) AS {n}" for n, p in L.APPARATUS.items()) + " FROM documents) " + " UNION ALL ".join(f"SELECT '{n}' AS rule, {n} AS n FROM c" for n in L.APPARATUS)


@query(r"""WITH c AS (SELECT count(*) - count(DISTINCT id) AS duplicate_ids, count(*) FILTER (text IS NULL OR trim(text) = '') AS empty_texts,
  count(*) FILTER (regexp_matches(text, '[a-z]-$')) AS trailing_hyphens, count(*) FILTER (NOT regexp_matches(text, '[.!?]$')) AS unterminated,
  count(*) FILTER (chunk_type IS NULL) AS untyped FROM question_sample2)
SELECT 'duplicate_ids' AS rule, duplicate_ids AS n FROM c UNION ALL SELECT 'empty_texts', empty_texts FROM c UNION ALL SELECT 'trailing_hyphens', trailing_hyphens FROM c
UNION ALL SELECT 'unterminated', unterminated FROM c UNION ALL SELECT 'untyped', untyped FROM c""")
def corpus_audit(spark, d):
    t = F.col("text")
    one = table(spark, d, "question_sample2").agg(
        (F.count("*") - F.count_distinct("id")).alias("duplicate_ids"),
        F.count_if(t.isNull() | (F.trim(t) == "")).alias("empty_texts"),
        F.count_if(t.rlike("[a-z]-$")).alias("trailing_hyphens"),
        F.count_if(~t.rlike("[.!?]$")).alias("unterminated"),
        F.count_if(F.col("chunk_type").isNull()).alias("untyped"),
    )
    return one.unpivot([], ["duplicate_ids", "empty_texts", "trailing_hyphens", "unterminated", "untyped"], "rule", "n")


@query("""WITH w AS (SELECT DISTINCT query_id, chunk_id FROM index_score), m AS (SELECT DISTINCT query_id, chunk_id FROM w ANTI JOIN (SELECT query_id, id AS chunk_id FROM pregnancy_scope_evidence_pack) p USING (query_id, chunk_id))
SELECT count(*) AS listed, (SELECT count(*) FROM m) AS missing, round(1.0 - CAST((SELECT count(*) FROM m) AS DOUBLE) / count(*), 6) AS coverage FROM w""")
def coverage(spark, d):
    w = table(spark, d, "index_score", "query_id", "chunk_id").distinct()
    have = table(spark, d, "pregnancy_scope_evidence_pack").select("query_id", F.col("id").alias("chunk_id"))
    marked = w.join(have.distinct().withColumn("has", F.lit(1)), ["query_id", "chunk_id"], "left")
    return marked.agg(F.count("*").alias("listed"), F.count_if(F.col("has").isNull()).alias("missing"), F.round(1.0 - F.count_if(F.col("has").isNull()) / F.count("*"), 6).alias("coverage"))


@query("""WITH e AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS norm FROM embeddings),
k AS (SELECT array_to_string(list_transform(embedding[1:16], lambda x: CAST(CAST(round(CAST(x AS DOUBLE) * 100000) AS BIGINT) AS VARCHAR)), ',') AS k, count(*) AS n FROM e GROUP BY 1)
SELECT count(*) AS n_vectors, count(*) FILTER (norm = 0) AS zero_vectors, count(*) FILTER (abs(norm - 1) > 0.001) AS off_norm, count(DISTINCT len(embedding)) AS n_dims,
 (SELECT coalesce(CAST(sum(n) AS BIGINT), 0) FROM k WHERE n > 1) AS colliding FROM e""")
def embedding_audit(spark, d):
    e = table(spark, d, "embeddings")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    key = F.array_join(F.transform(F.slice("embedding", 1, 16), lambda x: F.round(x.cast("double") * 100000).cast("bigint").cast("string")), ",")
    each = e.select(norm.alias("norm"), F.size("embedding").alias("dims"), key.alias("k"))
    whole = each.agg(F.count("*").alias("n_vectors"), F.count_if(F.col("norm") == 0).alias("zero_vectors"), F.count_if(F.abs(F.col("norm") - 1) > 0.001).alias("off_norm"), F.count_distinct("dims").alias("n_dims"))
    same = each.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("colliding"))
    return whole.crossJoin(same)  # one row each


@query("""WITH w AS (SELECT row_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+', 0)) AS w, 1 AS a, 0 AS b FROM page_record WHERE text IS NOT NULL UNION ALL SELECT row_id, unnest(regexp_extract_all(lower(pdfplumber_text), '[a-z0-9]+', 0)), 0, 1 FROM page_record WHERE text IS NOT NULL AND pdfplumber_text IS NOT NULL),
c AS (SELECT row_id, w, sum(a) AS a, sum(b) AS b FROM w GROUP BY ALL) SELECT row_id, round(CAST(sum(least(a, b)) AS DOUBLE) / sum(a), 6) AS overlap FROM c GROUP BY row_id HAVING sum(a) > 0""")
def word_overlap(spark, d):
    """The share of a text's words, counted as often as they occur, that another reading of the page has, too."""
    def words(c, a, b):
        found = F.explode(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))).alias("w")
        return p.select("row_id", found, F.lit(a).alias("a"), F.lit(b).alias("b"))

    p = pages(spark, d).where("text is not null")
    c = words("text", 1, 0).unionByName(words("pdfplumber_text", 0, 1)).groupBy("row_id", "w").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    g = c.groupBy("row_id").agg(F.sum(F.least("a", "b")).alias("both"), F.sum("a").alias("n")).where("n > 0")
    return g.select("row_id", F.round(F.col("both") / F.col("n"), 6).alias("overlap"))


@query("SELECT doc_id, source, CAST(length(text) AS BIGINT) AS n FROM documents WHERE regexp_matches(text, '(?i)hyperkalaemia|potassium')")
def regex_search(spark, d):
    return docs(spark, d).where(F.col("text").rlike("(?i)hyperkalaemia|potassium")).select("doc_id", "source", F.length("text").cast("bigint").alias("n"))


@query("""WITH r AS (SELECT sample_id, chunk_type, row_number() OVER (PARTITION BY chunk_type ORDER BY sha1('17:' || id), sample_id) AS rn FROM question_sample2 WHERE chunk_type IS NOT NULL)
SELECT sample_id, chunk_type FROM r WHERE rn <= 20""")
def stratified_sample(spark, d):
    q = table(spark, d, "question_sample2").where("chunk_type is not null").select("sample_id", "chunk_type", F.sha1(F.concat(F.lit("17:"), "id").cast("binary")).alias("h"))
    w = Window.partitionBy("chunk_type").orderBy("h", "sample_id")
    return q.withColumn("rn", F.row_number().over(w)).where("rn <= 20").select("sample_id", "chunk_type")


# Segmentation


@query(f"""WITH {LINES_SQL}, c AS (SELECT doc_id, max(line_no) FILTER (regexp_matches(line, '^[0-9]+\\.[0-9]+ ')) AS cut FROM lines GROUP BY doc_id)
SELECT doc_id, count(*) AS kept FROM lines JOIN c USING (doc_id) WHERE cut IS NULL OR line_no < cut GROUP BY doc_id""")
def tail_cutoff(spark, d):
    ls = lines(spark, d)
    w = Window.partitionBy("doc_id")
    marked = ls.withColumn("cut", F.max(F.when(F.col("line").rlike(r"^[0-9]+\.[0-9]+ "), F.col("line_no"))).over(w))
    return marked.where("cut is null or line_no < cut").groupBy("doc_id").agg(F.count("*").alias("kept"))


@query(f"""WITH {LINES_SQL}, h AS (SELECT *, CASE WHEN {_IS_HEADING} THEN {_LEVEL} END AS level FROM lines),
a AS (SELECT doc_id, line_no, line, level, last_value(CASE WHEN level <= 1 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS section FROM h)
SELECT section, count(*) AS n_lines, sum(length(line)) AS n_chars FROM a WHERE section IS NOT NULL AND level IS NULL AND line <> '' GROUP BY section""")
def section_path(spark, d):
    ls = lines(spark, d)
    is_heading = F.col("line").rlike(r"^([0-9]+\.[0-9]+ |Chapter |Appendix )") & (F.length("line") < 80)
    level = F.when(is_heading, T.heading_level(F.col("line")))
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    a = ls.withColumn("level", level).withColumn("section", F.last(F.when(F.col("level") <= 1, F.col("line")), ignorenulls=True).over(w))
    return a.where("section is not null and level is null and line <> ''").groupBy("section").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


SQL["section_path"] = SQL["section_path"].replace("sum(length(line)) AS n_chars", "CAST(sum(length(line)) AS BIGINT) AS n_chars")


@query(f"""WITH {LINES_SQL}, b AS (SELECT doc_id, line_no, line, lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS nxt FROM lines WHERE line <> '')
SELECT doc_id, line_no FROM b WHERE nxt IS NOT NULL AND length(nxt) > length(line) AND starts_with(nxt, line)""")
def skip_truncated_heading(spark, d):
    w = Window.partitionBy("doc_id").orderBy("line_no")
    b = lines(spark, d).where("line <> ''").withColumn("nxt", F.lead("line").over(w))
    return b.where((F.length("nxt") > F.length("line")) & F.col("nxt").startswith(F.col("line"))).select("doc_id", "line_no")


@query(r"""WITH l AS (SELECT row_id, i AS line_no, trim(ls[i]) AS line FROM (SELECT row_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT row_id, string_split(text, E'\n') AS ls FROM page_record WHERE text IS NOT NULL)))
SELECT row_id, line_no, regexp_extract(line, '^(Table|Figure) [0-9]+', 0) AS label, line AS caption FROM l WHERE regexp_matches(line, '^(Table|Figure) [0-9]+')""")
def caption_chunks(spark, d):
    ls = pages(spark, d).where("text is not null").select("row_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    ls = ls.select("row_id", (F.col("p") + 1).cast("bigint").alias("line_no"), F.trim("line").alias("caption")).where(F.col("caption").rlike("^(Table|Figure) [0-9]+"))
    return ls.select("row_id", "line_no", F.regexp_extract("caption", "^(Table|Figure) [0-9]+", 0).alias("label"), "caption")


@query(r"""WITH l AS (SELECT row_id, i AS line_no, trim(ls[i]) AS line FROM (SELECT row_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT row_id, string_split(text, E'\n') AS ls FROM page_record WHERE text IS NOT NULL)))
SELECT row_id, line_no, array_to_string(list_filter(list_transform(range(1, 4), lambda k: CASE WHEN length(trim(string_split(line, '|')[k])) > 0 THEN ['name', 'first', 'second'][k] || ': ' || trim(string_split(line, '|')[k]) END), lambda x: x IS NOT NULL), '; ') AS row_text
FROM l WHERE len(string_split(line, '|')) = 3""")
def table_rows(spark, d):
    ls = pages(spark, d).where("text is not null").select("row_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    cells = ls.select("row_id", (F.col("p") + 1).cast("bigint").alias("line_no"), F.split(F.trim("line"), r"\|").alias("c")).where(F.size("c") == 3)
    header = F.array(F.lit("name"), F.lit("first"), F.lit("second"))
    parts = F.zip_with(header, "c", lambda h, c: F.when(F.length(F.trim(c)) > 0, F.concat(h, F.lit(": "), F.trim(c))))
    return cells.select("row_id", "line_no", F.array_join(F.filter(parts, lambda x: x.isNotNull()), "; ").alias("row_text"))


@query("""SELECT e.event_id, (SELECT arg_min(c.event_id, (abs(epoch_us(c.ts) - epoch_us(e.ts)), c.event_id)) FROM events c WHERE c.user_id = e.user_id AND c.event_type = 'click') AS nearest
FROM events e WHERE e.event_type = 'error' AND EXISTS (SELECT 1 FROM events c WHERE c.user_id = e.user_id AND c.event_type = 'click')""")
def nearest_event(spark, d):
    """Nearest neighbour in time within a key, without pairing the key's rows: the last click before and
    the first one after are carried over by two windows, and the nearer of the two is taken."""
    e = table(spark, d, "events", "event_id", "ts", "user_id", "event_type").where("event_type in ('error', 'click')")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    click = F.when(F.col("event_type") == "click", F.struct(us.alias("t"), "event_id"))
    order = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "click", 0).otherwise(1), "event_id")
    back = F.last(click, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(click, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    both = e.select("event_id", "event_type", us.alias("t"), back.alias("b"), ahead.alias("a")).where("event_type = 'error'")
    options = F.array_sort(F.filter(F.array(*[F.struct(F.abs(F.col(f"{x}.t") - F.col("t")).alias("gap"), F.col(f"{x}.event_id").alias("id")) for x in "ab"]), lambda o: o["id"].isNotNull()))
    return both.where(F.size(options) > 0).select("event_id", options[0]["id"].alias("nearest"))


@query("""SELECT l_orderkey, min(l_quantity) AS x0, min(l_extendedprice) AS y0, max(l_quantity) AS x1, max(l_extendedprice) AS y1 FROM lineitem GROUP BY l_orderkey""")
def bbox_union(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey", "l_quantity", "l_extendedprice")
    return li.groupBy("l_orderkey").agg(F.min("l_quantity").alias("x0"), F.min("l_extendedprice").alias("y0"), F.max("l_quantity").alias("x1"), F.max("l_extendedprice").alias("y1"))


@query("""WITH box AS (SELECT p_partkey, p_brand, CAST(p_size AS DOUBLE) AS x0, CAST(p_size AS DOUBLE) + 10 AS x1, p_retailprice * 20 AS y0, p_retailprice * 30 AS y1 FROM part)
SELECT p_partkey, count(*) AS points FROM box JOIN lineitem ON l_partkey = p_partkey AND l_quantity BETWEEN x0 AND x1 AND l_extendedprice BETWEEN y0 AND y1 GROUP BY p_partkey""")
def point_in_box(spark, d):
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice")
    box = table(spark, d, "part").select("p_partkey", size.alias("x0"), (size + 10).alias("x1"), (price * 20).alias("y0"), (price * 30).alias("y1"))
    points = table(spark, d, "lineitem", "l_partkey", "l_quantity", "l_extendedprice")
    inside = (F.col("l_partkey") == F.col("p_partkey")) & F.col("l_quantity").between(F.col("x0"), F.col("x1")) & F.col("l_extendedprice").between(F.col("y0"), F.col("y1"))
    return box.join(points, inside).groupBy("p_partkey").agg(F.count("*").alias("points"))


@query("""SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR), ' ' ORDER BY -round_even(l_quantity / 6, 0), l_extendedprice, l_linenumber) AS reading FROM lineitem GROUP BY l_orderkey""")
def reading_order(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    row = F.struct((-F.bround(F.col("l_quantity") / 6, 0)).alias("y"), F.col("l_extendedprice").alias("x"), "l_linenumber")
    g = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(row)).alias("r"))  # at most seven lines an order
    return g.select("l_orderkey", F.array_join(F.transform("r", lambda x: x["l_linenumber"].cast("string")), " ").alias("reading"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def antijoin_backfill(spark, d):
    c, o = table(spark, d, "customer", "c_custkey", "c_name"), table(spark, d, "orders", "o_custkey", "o_orderstatus").where("o_orderstatus = 'F'")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti")


@query("""WITH c AS (SELECT ev_id, document_id || '_p' || coalesce(regexp_extract(id, '_p([0-9]+)_', 1), '') || '_' || CASE WHEN length(trim(regexp_replace(lower(substr(raw_text, 1, 60)), '[^a-z0-9]+', '_', 'g'), '_')) > 0
   THEN substr(trim(regexp_replace(lower(substr(raw_text, 1, 60)), '[^a-z0-9]+', '_', 'g'), '_'), 1, 60) ELSE 'chunk' END AS base FROM pregnancy_scope_evidence_pack)
SELECT ev_id, CASE WHEN rn = 1 THEN base ELSE base || '_' || rn END AS chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY ev_id) AS rn FROM c)""")
def chunk_record(spark, d):
    e = table(spark, d, "pregnancy_scope_evidence_pack")
    base = F.concat_ws("_", "document_id", F.concat(F.lit("p"), F.regexp_extract("id", "_p([0-9]+)_", 1)), T.slug(F.substring("raw_text", 1, 60)))
    c = e.select("ev_id", base.alias("base")).withColumn("rn", F.row_number().over(Window.partitionBy("base").orderBy("ev_id")))
    return c.select("ev_id", F.when(F.col("rn") == 1, F.col("base")).otherwise(F.concat_ws("_", "base", "rn")).alias("chunk_id"))


@query(r"""SELECT row_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '(?:Figure|Table|Fig\.|Abb\.) ?[0-9]+', 0))), ', ') AS refs FROM page_record WHERE text IS NOT NULL""")
def cross_references(spark, d):
    refs = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?:Figure|Table|Fig\.|Abb\.) ?[0-9]+"), F.lit(0))))
    return pages(spark, d).where("text is not null").select("row_id", F.array_join(refs, ", ").alias("refs"))


@query("""SELECT source, lang, CAST(grouping(source) AS INT) AS all_sources, CAST(grouping(lang) AS INT) AS all_langs, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars, round(avg(n_chars), 4) AS mean_chars
FROM documents GROUP BY GROUPING SETS ((source), (lang), ())""")
def corpus_summary(spark, d):
    g = docs(spark, d).groupingSets([["source"], ["lang"], []], "source", "lang")
    return g.agg(
        F.grouping("source").cast("int").alias("all_sources"), F.grouping("lang").cast("int").alias("all_langs"),
        F.count("*").alias("docs"), F.sum("n_chars").alias("chars"), F.round(F.avg("n_chars"), 4).alias("mean_chars"),
    ).select("source", "lang", "all_sources", "all_langs", "docs", "chars", "mean_chars")
