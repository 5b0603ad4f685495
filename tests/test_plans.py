"""Plans are the ones wanted: no nested loops over two growing tables, filters and columns reach the scan."""

import re

import pytest

from tarnwell import registry

SF = "/root/testdata/sf0.001"
#: a one-row aggregate beside another, or bands that do not grow
LOOPS = {"embedding_audit", "band_lookup", "backfill_invariant", "bootstrap_ci", "paired_bootstrap"}
CHECKED = [
    "tokenize", "tfidf_weights", "tfidf_search", "bm25", "convex_fusion", "rrf_fusion", "rerank_blend", "claim_agreement", "premise_supported", "band_containment", "point_in_box", "asof_join", "nearest_event",
    "best_prefix_match", "reannotate", "resolve_refs", "top_orders", "local_suppliers", "hash_join", "p6_found", "weight_sweep", "ablation", "dense_topk", "maxsim", "hyde_max", "hyde_blend", "embedding_ablation", "hybrid_search", "search", "build_answer", "sweeps", "neighbour_context",
]


def plan(spark, name):
    return registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", CHECKED)
def test_no_cartesian(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text
    loops = len(re.findall("BroadcastNestedLoopJoin", text))
    # the one-row corpus size joins by a loop over one row
    assert name in LOOPS or loops <= text.count("n_docs") + text.count("avgdl")


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "scan_filter_project")
    assert "GreaterThan(l_quantity,49.0)" in text
    read = re.search(r"ReadSchema: struct<([^>]*)>", text)[1]
    assert set(re.findall(r"(\w+):", read)) == {"l_orderkey", "l_linenumber", "l_quantity", "l_discount"}


def test_fusion_reads_four_columns(spark):
    text = plan(spark, "convex_fusion")
    for read in re.findall(r"ReadSchema: struct<([^>]*)>", text):
        assert "scored_at" not in read and "loaded_at" not in read and "dense_model" not in read
