"""Graded-relevance metrics, bootstrap intervals, claims and verification of answers."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


def gains(ranked: DataFrame, judged: DataFrame, qkey: str, item: str) -> DataFrame:
    """Ranked items (qkey, item, rank) with their grade, 0 where none is given."""
    return ranked.join(judged, [qkey, item], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))


def ir_metrics(ranked: DataFrame, judged: DataFrame, qkey: str, item: str, k: int = 10) -> DataFrame:
    """Per query with any judgement: nDCG@k with linear gain, recall@k, precision@5, reciprocal rank of
    the first item of grade 2, and the number of relevant items."""
    hits = gains(ranked, judged, qkey, item).where(F.col("rank") <= k)
    dcg = F.sum(F.col("grade") / F.log2(F.col("rank") + 1))
    per = hits.groupBy(qkey).agg(
        dcg.alias("dcg"), F.count_if(F.col("grade") > 0).alias("found"), F.count_if((F.col("grade") > 0) & (F.col("rank") <= 5)).alias("found5"),
        F.min(F.when(F.col("grade") == 2, F.col("rank"))).alias("first2"), F.min(F.when(F.col("grade") > 0, F.col("rank"))).alias("first"),
    )
    w = Window.partitionBy(qkey).orderBy(F.desc("grade"), item)
    best = judged.withColumn("r", F.row_number().over(w))
    ideal = best.groupBy(qkey).agg(F.sum(F.when(F.col("r") <= k, F.col("grade") / F.log2(F.col("r") + 1)).otherwise(0.0)).alias("ideal"), F.count_if(F.col("grade") > 0).alias("relevant"))
    both = ideal.join(per, qkey, "left").where("relevant > 0")
    return both.select(
        qkey, F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(0.0).alias("ndcg"),
        (F.coalesce("found", F.lit(0)) / F.col("relevant")).alias("recall"), (F.coalesce("found5", F.lit(0)) / 5.0).alias("p5"),
        F.coalesce(1.0 / F.col("first2"), F.lit(0.0)).alias("rr"), "first", "relevant",
    )


def bootstrap(values: DataFrame, key: str, value: str, resamples: int = 3_000, seed: int = 17) -> DataFrame:
    """(mean, lo, hi): percentile interval of a mean over resamples.

    Poisson resampling: each row draws its own weight for each resample from a digest of its key, so
    resamples need no collected table, add up in one aggregate, and any engine can draw the same ones."""
    drawn = F.conv(F.substring(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.col("r").cast("string"), F.lit(str(seed)))), 1, 7), 16, 10)
    u = (drawn.cast("double") + 0.5) / float(1 << 28)
    rows = values.select(key, value, F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("r")).select(value, "r", u.alias("u"))
    weight = sum((F.when(F.col("u") > c, 1).otherwise(0) for c in POISSON), F.lit(0))
    means = rows.withColumn("w", weight).groupBy("r").agg(F.try_divide(F.sum(F.col(value) * F.col("w")), F.sum("w")).alias("m"))
    ends = means.agg(F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi"))
    return values.agg(F.avg(value).alias("mean")).crossJoin(ends)  # one row each


def _poisson(n: int = 8) -> list[float]:
    out, total, p = [], 0.0, math.exp(-1.0)
    for k in range(n):
        total += p
        out.append(total)
        p /= k + 1
    return out


#: the distribution function of Poisson(1) at 0, 1, ...
POISSON = _poisson()


def agreement(claims: DataFrame, by: list[str], source: str, low: str, high: str) -> DataFrame:
    """Groups of claims of at least two sources: ``incompatible`` where their bounds exclude each other,
    ``differs`` where they are not all alike (give each source's headline claims to compare those), else
    ``agree``."""
    g = claims.groupBy(*by).agg(
        F.count_distinct(source).alias("sources"), F.max(low).alias("max_low"), F.min(high).alias("min_high"), F.count_distinct(low, high).alias("stated")
    ).where("sources >= 2")
    status = F.when(F.col("max_low") > F.col("min_high"), "incompatible").when(F.col("stated") > 1, "differs").otherwise("agree")
    return g.select(*by, "sources", status.alias("status"))


_VALUE = re.compile(r"(?<![\d.])(\d+(?:\.\d+)?)\s?(mL ?/ ?min(?:(?: per |/)1\.73 ?m[²2])?|mg ?/ ?mmol|mmol ?/ ?L|µmol ?/ ?L|mg ?/ ?g\b|mm ?Hg|g ?/ ?L\b|ng ?/ ?mL|mg\b|%|weeks|months|years|days)", re.I)
_RANGE = re.compile(r"(?<![\d.])(\d+(?:\.\d+)?)\s?(?:-|–|to|and)\s?(\d+(?:\.\d+)?)(?!\.?\d)")
_CITED = re.compile(r"\[(\d+)\]")


_SENTENCE = re.compile(r"(?<=[.;!?])\s+")
_LONE = re.compile(r"(?<![\d.])\d+(?:\.\d+)?(?!\.?\d)")
#: words by which a sentence says where a value belongs, rather than what to aim at
_PLACES = re.compile(r"\b(?:fall|sit|lie|belong|rank|count|correspond)s?\b[^.;]{0,40}?\b(?:in|into|within|to|as|under)\b|\b(?:is|was) (?:in|within|classified|categori[sz]ed)\b|\b(?:stage|category|class) is\b", re.I)


def verify_answer(answer: str | None, evidence: list[str], question: str | None = None) -> list[str]:
    """Problems of an answer: no valid citation, citations of no evidence, values with units or ranges that
    the cited evidence does not state.  Blanks don't count.

    A value that is an end of a range in its own sentence is left to the range.  A value of the question is
    let through where its sentence only says to which of the evidence's ranges it belongs: the value lies in
    a range that the cited evidence states, and the sentence places it there."""
    if not answer or not answer.strip():
        return ["empty"]
    cited = [int(n) for n in _CITED.findall(answer)]
    valid = sorted({n for n in cited if 1 <= n <= len(evidence)})
    problems = [f"citation {n}" for n in sorted(set(cited) - set(valid))]
    if not valid:
        return [*problems, "no_citation"]
    said = " ".join(evidence[n - 1] or "" for n in valid)
    text = re.sub(r"\s+", "", said).lower()
    stated = [(float(a), float(b)) for a, b in _RANGE.findall(said)]
    given = {float(v) for v in _LONE.findall(question or "")}
    for sentence in _SENTENCE.split(_CITED.sub("", answer)):
        ends = set()
        for a, b in _RANGE.findall(sentence):
            ends |= {a, b}
            if not any(f"{a}{sep}{b}" in text for sep in ("-", "–", "to", "and")):
                problems.append(f"range {a}-{b}")
        for v, unit in _VALUE.findall(sentence):
            if v in ends or f"{v}{re.sub(r'\s+', '', unit)}".lower() in text:
                continue
            if float(v) in given and any(a <= float(v) <= b for a, b in stated) and _PLACES.search(sentence):
                continue
            problems.append(f"value {v} {unit}")
    return problems


def verify(answers: DataFrame, key: str, answer: str, evidence: str, question: str | None = None) -> DataFrame:
    """(key, ok, problems) of answers with an array of numbered evidence texts, and the question if given."""

    def run(it):
        for pdf in it:
            asked = pdf["question"]
            found = [verify_answer(a, list(e) if e is not None else [], q) for a, e, q in zip(pdf[answer], pdf[evidence], asked, strict=True)]
            yield pd.DataFrame({key: pdf[key], "ok": [not p for p in found], "problems": ["; ".join(p) for p in found]})

    kind = dict(answers.dtypes)[key]
    own = answers.select(key, answer, evidence, (F.col(question) if question else F.lit(None).cast("string")).alias("question"))
    return own.mapInPandas(run, f"`{key}` {kind}, ok boolean, problems string")


def squeezed(t: Column) -> Column:
    return F.lower(F.regexp_replace(t, r"\s+", ""))
