import pandas as pd
import pytest

from tarnwell.functions import text as T
from tarnwell.operators import fusion, metrics, relational
from tarnwell.sources import latest_by_key


def test_spelled_numbers(spark):
    df = spark.createDataFrame([("at sixty-five or eleven",), ("none",), (None,)], "t string")
    assert [r[0] for r in df.select(T.spelled_numbers(df.t)).collect()] == [[65.0, 11.0], [], None]


def test_common_prefix(spark):
    df = spark.createDataFrame([("abcdef", "abcxyz"), ("", "a"), ("same", "same")], "a string, b string")
    assert [r[0] for r in df.select(T.common_prefix(df.a, df.b)).collect()] == [3, 0, 4]


def test_minmax_constant_and_null(spark):
    df = spark.createDataFrame([("q", "a", 1.0), ("q", "b", 1.0), ("r", "a", None), ("r", "b", 2.0), ("r", "c", 4.0)], "q string, i string, s double")
    got = {(r.q, r.i): r.s for r in fusion.minmax(df, "q", ["s"]).collect()}
    assert got == {("q", "a"): 0.0, ("q", "b"): 0.0, ("r", "a"): 0.0, ("r", "b"): 0.0, ("r", "c"): 1.0}


def test_convex_skips_absent_signal(spark):
    df = spark.createDataFrame([("q", "a", 1.0, None), ("q", "b", 3.0, None)], "q string, i string, x double, y double")
    got = {r.i: r.fused for r in fusion.convex(df, "q", {"x": 0.4, "y": 0.6}).collect()}
    assert got == {"a": 0.0, "b": 1.0}


def test_rerank_tail_cannot_overtake(spark):
    df = spark.createDataFrame([("q", f"{k:02}", 1.0 - k / 100, 0.0) for k in range(40)], "q string, i string, fused double, rr double")
    got = fusion.rerank_blend(df, "q", "i", "rr").orderBy("rank").collect()
    assert all(a.final >= b.final for a, b in zip(got, got[1:]))


def test_diversify_exempts_new_values(spark):
    rows = [("q", "a", "s", 1.0, ["x"]), ("q", "b", "s", 0.9, ["x"]), ("q", "c", "s", 0.85, ["y"]), ("q", "d", "t", 0.8, [])]
    df = spark.createDataFrame(rows, "q string, i string, sec string, s double, v array<string>")
    assert [r.i for r in fusion.diversify(df, "q", "i", "sec", "s", "v", 4).orderBy("position").collect()] == ["a", "c", "d", "b"]


def test_asof_and_range(spark):
    l = spark.createDataFrame([("k", 5, "l1"), ("k", 1, "l2"), ("j", 9, "l3")], "k string, t int, name string")
    r = spark.createDataFrame([("k", 3, 30), ("k", 5, 50)], "k string, t int, v int")
    got = {x.name: x.v for x in relational.asof(l, r, "k", "t", ["v"]).collect()}
    assert got == {"l1": 50, "l2": None, "l3": None}
    pts = spark.createDataFrame([(1.0,), (9.99,), (10.0,), (25.0,)], "p double")
    bands = spark.createDataFrame([("a", 0.0, 10.0), ("b", 10.0, 30.0)], "n string, lo double, hi double")
    assert sorted((x.n, x.p) for x in relational.range_join(pts, bands, "p", "lo", "hi", 4.0).collect()) == [("a", 1.0), ("a", 9.99), ("a", 10.0), ("b", 10.0), ("b", 25.0)]


def test_latest_by_key_keeps_full_value(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, " "), ("b", 1, None)], "k string, n int, v string")
    assert {r.k: (r.n, r.v) for r in latest_by_key(df, "k", "n", "v").collect()} == {"a": (1, "x"), "b": (1, None)}


def test_ir_metrics(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "q int, i string, rank int")
    judged = spark.createDataFrame([(1, "b", 2), (1, "z", 1), (2, "y", 2)], "q int, i string, grade int")
    got = {r.q: r for r in metrics.ir_metrics(ranked, judged, "q", "i").collect()}
    assert abs(got[1].ndcg - (2 / 1.5849625007) / (2 + 1 / 1.5849625007)) < 1e-9
    assert got[1].recall == 0.5 and got[1].rr == 0.5 and got[2].ndcg == 0.0 and got[2].rr == 0.0


def test_verify_answer():
    ev = ["Stop below 30 mL/min/1.73 m² or at 5.5 mmol/L.", "Between 10 and 12 g/L is fine."]
    assert metrics.verify_answer("Stop below 30 mL/min/1.73 m² [1].", ev) == []
    assert metrics.verify_answer("Aim for 10 and 12 g/L [2].", ev) == []
    assert metrics.verify_answer("Aim for 10 to 13 g/L [2].", ev) == ["range 10-13"]
    assert metrics.verify_answer("Stop below 40 mL/min/1.73 m² [1].", ev) == ["value 40 mL/min/1.73 m²"]
    assert metrics.verify_answer("Stop below 30 mL/min/1.73 m².", ev) == ["no_citation"]
    assert metrics.verify_answer("At 5.5 mmol/L [2].", ev) == ["value 5.5 mmol/L"]
    assert metrics.verify_answer(None, ev) == ["empty"]
    assert metrics.verify_answer("x [9]", ev) == ["citation 9", "no_citation"]


EVIDENCE = [
    "Aim for a systolic pressure of < 120 mm Hg by standard office measurement.",
    "Clinic systolic below 140 mmHg (range 120 to 139 mmHg) and diastolic below 90 mmHg where ACR is under 70 mg/mmol.",
    "With ACR above 70 mg/mmol keep systolic below 130 mmHg.",
    "Stage C: filtration 30 - 44",
    "Stage D: filtration 15 - 29",
]


@pytest.mark.parametrize("answer, question, ok", [
    ("A systolic target of < 120 mm Hg is advised [1]; another body says below 140 mmHg for an ACR under 70 mg/mmol [2].", None, True),
    ("The target is <120mmHg [1].", None, True),
    ("Treat to below 132 mm Hg [1].", None, False),  # stated nowhere
    ("Intensify above 700 mg/g [3].", None, False),  # converted
    ("Keep it below 135 mmHg [1][2].", None, False),  # between two stated values
    ("Aim below 130 mmHg [1].", None, False),  # stated by another source than the cited one
    ("The target is < 120 mm Hg [8].", None, False),  # no such evidence
    ("Pressure should be lowered.", None, False),  # nothing cited
    ("Under 70 mg/mmol the range is 120 to 139 mmHg [2].", None, True),
    ("Stage C spans 30 to 49 [4].", None, False),  # another range
    ("Recommendations 1.6.1 to 1.6.2 set < 120 mm Hg [1].", None, True),  # numbers of sections are no range
    ("Stage D means 15 - 29 ml/min per 1.73 m2 [5].", None, True),  # the unit stands in the table's head
    ("Stage D means 15 - 29 ml/min per 1.73 m2 [4].", None, False),  # cited to another row
    ("Keep diastolic below 85 mmHg [2].", None, False),
    ("A rate of 38 ml/min falls in stage C [4].", "My patient has a rate of 38, what stage is it?", True),
    ("Aim for 38 ml/min [4].", "My patient has a rate of 38, what stage is it?", False),  # recommended, not placed
    ("A rate of 38 ml/min falls in stage C [4].", None, False),  # not in the question
    ("A rate of 50 ml/min falls in stage C [4].", "Is 50 in stage C?", False),  # outside the range
    ("The range is 120 to 139 mmHg [2]. Then 139 mmHg is safe. Take 128 mmHg [2].", None, False),  # only its own sentence counts
])
def test_verify_cases(answer, question, ok):
    assert (metrics.verify_answer(answer, EVIDENCE, question) == []) is ok


def test_bootstrap_covers_mean(spark):
    df = spark.createDataFrame(pd.DataFrame({"k": range(200), "v": [k % 10 / 10 for k in range(200)]}))
    r = metrics.bootstrap(df, "k", "v", 200).collect()[0]
    assert r.lo < r.mean < r.hi and r.hi - r.lo < 0.15


def test_streams_equal_batch(spark):
    from tarnwell.plans import relational as plan

    sf = "/root/testdata/sf0.001"
    batch = {tuple(r) for r in plan.tumbling_windows(spark, sf).collect()}
    streamed = {(r.start.replace(tzinfo=None), r.event_type, r.n, r.total) for r in plan.stream_windows(spark, sf).collect()}
    assert streamed and streamed <= {(s.replace(tzinfo=None), t, n, v) for s, t, n, v in batch}


def test_band_near_its_quantity(spark):
    from tarnwell.operators import search

    far = "x" * 100
    rows = [
        ("Is an eGFR of 38 low?", f"GFR 30-44 is stage C. {far} ages 30-50 {far}", 1.0),
        ("Is an eGFR of 38 low?", f"{far} ages 30-50 {far}", 0.0),  # no mention of the quantity near the band
        ("A child of thirty-eight?", "ages 30-50", 1.0),  # no quantity asked for: all bands count
        ("Is an eGFR of 38 low?", "GFR 30-44, 45-59, 60-89, 15-29", 0.5 + 0.5 / 4),
        ("Is an eGFR of 38 low?", "GFR under 40", 1.0),
        ("Is it low?", "GFR 30-44", 0.0),
        (None, "GFR 30-44", None),
    ]
    df = spark.createDataFrame([(k, q, t) for k, (q, t, _) in enumerate(rows)], "k int, q string, t string")
    got = {r.k: r.b for r in df.select("k", search.band(df.q, df.t, search.Config()).alias("b")).collect()}
    assert [got[k] for k in range(len(rows) - 1)] == [w for _, _, w in rows[:-1]]


def test_nearest_against_brute_force(spark):
    import numpy as np

    from tarnwell.operators import encoders

    rng = np.random.default_rng(5)
    v, q = rng.normal(size=(300, 8)).round(1), rng.normal(size=(7, 8)).round(1)
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(999, None)], "id long, v array<double>").repartition(5)
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)] + [(77, None)], "qid long, v array<double>")
    for block in (4_096, 3):
        found = encoders.nearest(queries, vectors, "qid", "id", 5, block=block).collect()
        for k in range(7):
            mine = sorted((-r.score, r.id) for r in found if r.qid == k)[:5]
            score = np.round(v @ q[k], 9)
            assert mine == sorted(zip((-score).tolist(), range(300), strict=True))[:5]
    assert encoders.nearest(queries.limit(0), vectors, "qid", "id", 5).count() == 0
    assert encoders.encoder("unknown").query_prefix == "" and encoders.encoder("hashed-dual").query_prefix == "query: "


def test_encode_defines_empty_texts(spark):
    from tarnwell.operators import encoders

    df = spark.createDataFrame([(1, "kidney kidney"), (2, ""), (3, None)], "k int, t string")
    got = {r.k: r.v for r in encoders.encode(df, "k", "t").collect()}
    assert abs(sum(x * x for x in got[1]) - 1) < 1e-9 and not any(got[2]) and not any(got[3]) and len(got[2]) == 64
