"""The search takes all queries of both gold tables: held against those tables and its own results."""

import math

import pytest

from tarnwell import registry
from tests.test_oracle import SF, con  # noqa: F401


def rows(spark, name):
    return [r.asDict() for r in registry.queries()[name](spark, SF).collect()]


@pytest.fixture(scope="module")
def cases(con):  # noqa: F811
    own = "case_key, query, relevance, lower(trim(slice)) AS slice"
    return con.sql(f"select * from (select {own} from ckd_gold_eval union all select {own} from heldout_chunkfirst) where query is not null").df().to_dict("records")


@pytest.fixture(scope="module")
def hits(spark, cases, con):  # noqa: F811
    """Of each case with a relevant chunk: the grades of its ten results in order, and all its grades."""
    keys = dict(con.sql("select id, sample_id from question_sample2").fetchall())
    found = {}
    for r in sorted(rows(spark, "hybrid_search"), key=lambda r: r["rank"]):
        found.setdefault(r["qid"], []).append(r["sample_id"])
    out = {}
    for c in cases:
        grades = {keys[i]: g for i, g in dict(c["relevance"]).items() if i in keys}
        if any(grades.values()):
            out[c["case_key"]] = [grades.get(s, 0) for s in found[c["case_key"]]], sorted(grades.values(), reverse=True)
    assert len(out) > 20
    return out


def gain(grades):
    return sum(g / math.log2(k + 2) for k, g in enumerate(grades[:10]))


@pytest.fixture(scope="module")
def ndcg(hits):
    return {q: gain(got) / gain(best) for q, (got, best) in hits.items()}


def mean(values):
    values = list(values)
    return sum(values) / len(values)


def near(a, b):
    return abs(a - b) < 2e-6


def every(cases):
    return sorted(c["case_key"] for c in cases)


def test_pairs_stay_in_their_task(spark):
    """One exchange, of the queries, and no join of pairs: what a search shuffles grows with the queries."""
    text = registry.queries()["hybrid_search"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "Join" not in text


def test_hybrid_search_of_all_queries(spark, cases):
    assert sorted({r["qid"] for r in rows(spark, "hybrid_search")}) == every(cases)


def test_metadata_signal_of_all_queries(spark, cases):
    assert sorted({r["qid"] for r in rows(spark, "metadata_signal")}) == every(cases)


def test_ablation_of_all_queries(spark, ndcg):
    assert near(next(r["ndcg"] for r in rows(spark, "ablation") if r["name"] == "usual"), mean(ndcg.values()))


def test_sweeps_of_all_queries(spark, cases, ndcg):
    dev = [ndcg[c["case_key"]] for c in cases if c["slice"] == "dev" and c["case_key"] < 500_000_000 and c["case_key"] in ndcg]
    assert near(next(r["ndcg"] for r in rows(spark, "sweeps") if r["name"] == "usual" and r["slice"] == "dev"), mean(dev))


def test_paired_bootstrap_of_all_queries(spark, ndcg):
    from tarnwell.plans import evaluation

    pairs = evaluation.variant_metrics(spark, SF, evaluation._PAIR, True).collect()
    usual, lexical = ({r.qid: r.ndcg for r in pairs if r["name"] == n} for n in ("usual", "lexical"))
    assert set(usual) == set(lexical) == set(ndcg) and all(near(usual[q], ndcg[q]) for q in ndcg)
    assert near(rows(spark, "paired_bootstrap")[0]["mean"], mean(usual[q] - lexical[q] for q in ndcg))


def test_bootstrap_ci_of_all_queries(spark, ndcg):
    r = rows(spark, "bootstrap_ci")[0]
    assert near(r["mean"], mean(ndcg.values())) and r["lo"] < r["mean"] < r["hi"]


def test_abstention_separation_of_all_queries(spark, cases):
    assert sum(r["n"] for r in rows(spark, "abstention_separation")) == len(cases)


def test_answer_correctness_of_all_queries(spark, cases):
    assert sorted(r["qid"] for r in rows(spark, "answer_correctness")) == every(cases)


def test_build_answer_of_all_queries(spark, cases):
    assert sorted(r["qid"] for r in rows(spark, "build_answer")) == every(cases)


def test_gate_order_of_all_queries(spark, cases):
    assert sorted(r["qid"] for r in rows(spark, "gate_order")) == every(cases)


def test_metrics_grouping_sets_of_all_queries(spark, ndcg):
    total = next(r for r in rows(spark, "metrics_grouping_sets") if r["g1"] and r["g2"] and r["g3"])
    assert total["n"] == len(ndcg) and abs(total["ndcg"] - mean(ndcg.values())) < 1e-4


def test_missed_list_of_all_queries(spark, hits):
    missed = {r["qid"]: len(r["missed"].split(",")) for r in rows(spark, "missed_list")}
    left = {q: sum(g > 0 for g in best) - sum(g > 0 for g in got) for q, (got, best) in hits.items()}
    assert missed == {q: n for q, n in left.items() if n}


def test_precision_ceiling_of_all_queries(spark, hits):
    r = rows(spark, "precision_ceiling")[0]
    assert near(r["p5"], mean(sum(g > 0 for g in got[:5]) / 5 for got, _ in hits.values()))
    assert near(r["ceiling"], mean(min(sum(g > 0 for g in best), 5) / 5 for _, best in hits.values()))


def test_recall_at_20_of_all_queries(spark, hits):
    recall = {r["qid"]: r["recall10"] for r in rows(spark, "recall_at_20")}
    assert set(recall) == set(hits)
    assert all(near(recall[q], sum(g > 0 for g in got) / sum(g > 0 for g in best)) for q, (got, best) in hits.items())


def test_success_at_k_of_all_queries(spark, hits):
    success = {r["k"]: r["success"] for r in rows(spark, "success_at_k")}
    assert all(near(success[k], mean(any(got[:k]) for got, _ in hits.values())) for k in (1, 3, 5, 10))


@pytest.mark.parametrize("name", ["ndcg", "ir_metrics", "collapsed_metrics", "headline_metrics", "search"])
def test_stated_queries_read_the_sliced_run(spark, name):
    """No postings of all pairs are joined for them: only the stored index and run are written."""
    from tarnwell.sources import store

    store._written.clear()
    rows(spark, name)
    made = {df.inputFiles()[0].rsplit("/", 2)[1].rsplit("-", 1)[0] for df in store._written.values()}
    assert "index" in made and not made & {"counts", "postings", "asked-postings", "vectors", "signals"}
