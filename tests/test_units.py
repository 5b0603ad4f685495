import math

from tarnwell.operators import units

SCHEMA = "claim_id long, quantity string, comparator string, value double, value_high double, unit string, document_id string, chunk_id string, span string, ids string, b int"


def claims(spark, *rows):
    full = [(i, q, c, v, h, u, "d", ch, s, "clash", 7) for i, (q, c, v, h, u, ch, s) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def common(spark, *rows):
    return {r.claim_id: r for r in units.common_claims(claims(spark, *rows)).collect()}


def test_units_from_column_and_span(spark):
    got = common(
        spark,
        ("acr", "<", 30.0, None, "MG/MMOL", "a", "x"),
        ("acr", "below", 265.2, None, None, "a", "It is below 265.2 milligrams per gram for adults."),
        ("potassium", "≥", 5.0, None, " mEq/L ", "a", None),
        ("haemoglobin", "between", 10.0, 12.0, "-", "a", "Haemoglobin target: between 10 and 12 grams per decilitre (X series)."),
        ("protein_intake", "=", 1.0, None, "g/lb/day", "a", None),
        ("kidney_failure_risk", "Greater than", 5.0, None, "per 1,000", "a", None),
        ("egfr", ">", 1.0, None, "mL/s/1.73 m²", "a", None),
    )
    assert math.isclose(got[0].common_value, 265.2) and got[0].direction == "below" and got[0].common_unit == "mg/g"
    assert math.isclose(got[1].common_value, 265.2) and got[1].unit_source == "span"
    assert got[2].common_value == 5.0 and got[2].direction == "above"
    assert (got[3].common_value, got[3].common_high) == (100.0, 120.0)
    assert math.isclose(got[4].common_value, 2.2046226)
    assert math.isclose(got[5].common_value, 0.5) and got[5].direction == "above"
    assert got[6].common_value == 60.0


def test_nulls_unknown_and_inference(spark):
    rows = [("systolic_blood_pressure", "<", float(v), None, "mmHg", f"c{v}", None) for v in range(110, 150)]
    n = len(rows)
    rows += [
        ("systolic_blood_pressure", "<", 130.0, None, None, "z", "target < 130."),  # no unit: the median decides
        ("systolic_blood_pressure", "<", 14.9, None, None, "c149", "target < 14.9."),  # the neighbour decides
        ("nothing", "<", 1.0, None, "mm", "z", None),
        ("acr", None, None, None, None, None, None),
        (None, None, None, None, None, None, None),
    ]
    got = common(spark, *rows)
    assert got[n].unit_source == "inferred" and got[n].common_value == 130.0
    assert got[n + 1].common_value == 149.0 and got[n + 1].unit_key == "cmhg"
    assert got[n + 2].unit_source == "unknown" and got[n + 2].common_value is None
    assert got[n + 3].common_value is None and got[n + 4].common_value is None


def test_same_bounds(spark):
    got = units.same_bounds(claims(
        spark,
        ("acr", "<", 30.0, None, "mg/mmol", "a", None),
        ("acr", "less than", 265.2, None, "mg/g", "a", None),
        ("acr", "<", 265.2, None, "mg/g", "b", None),  # another chunk
        ("acr", ">", 265.2, None, "mg/g", "a", None),  # another direction
        ("acr", "<", 30.0, None, "mg/mmol", "a", None),  # extracted twice
        ("acr", "<", None, None, "mg/g", "a", None),
        ("acr", None, 265.2, None, "mg/g", "a", None),
        ("acr", "between", 30.0, 60.0, "mg/mmol", "a", None),
        ("acr", "Between", 0.2652, 0.5304, "g/g", "a", None),
        ("acr", "between", 0.2652, 0.7, "g/g", "a", None),
    ))
    assert {tuple(r) for r in got.collect()} == {(0, 1), (1, 4), (7, 8)}


def test_one_hot_chunk_against_brute_force(spark):
    rows = [("acr", "<", round(8.84 * v, 4) if k % 3 else v, None, "mg/g" if k % 3 else "mg/mmol", "hot", None) for k, v in enumerate([10.0 + (k % 37) * 0.013 for k in range(240)])]
    got = {tuple(r) for r in units.same_bounds(claims(spark, *rows)).collect()}
    common_ = [r[2] * (1.0 if r[4] == "mg/g" else 8.84) for r in rows]
    want = {
        (i, j) for i in range(len(rows)) for j in range(i + 1, len(rows))
        if abs(common_[i] - common_[j]) <= 0.01 * max(common_[i], common_[j]) + 1e-12 and abs(rows[i][2] - rows[j][2]) > 0.01 * max(rows[i][2], rows[j][2])
    }
    assert got == want and want


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert units.same_bounds(empty).count() == 0 and units.common_claims(empty).count() == 0


def test_identity_units(spark):
    rows = [("s1", 2.0 * k, 1.5, 3.0 * k) for k in range(1, 9)] + [("s2", 2000.0 * k, 1.5, 3.0 * k) for k in range(1, 9)] + [("s2", None, 1.5, 3.0)]
    df = spark.createDataFrame(rows, "src string, volume double, density double, mass double")
    columns = {"volume": (1.0, {"l": 1.0, "ml": 0.001}), "density": (1.0, {"kg/l": 1.0}), "mass": (-1.0, {"kg": 1.0, "g": 0.001})}
    got = {r.src: r for r in units.identity_units(df, ["src"], columns).collect()}
    assert got["s2"].units["volume"] == "ml" and got["s2"].units["mass"] == "kg" and got["s2"].unique
    assert got["s1"].residual < 1e-9 and not got["s1"].unique  # litres and kilograms fit as well as millilitres and grams
