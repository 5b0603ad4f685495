"""Queries take all rows: held against brute force over the tables at the smallest scale."""

import hashlib
import os
import re
from decimal import Decimal

from tarnwell import registry
from tarnwell.functions import lexicon as L, text as T
from tests.test_oracle import SF, con  # noqa: F401


def rows(spark, name):
    return [tuple(r) for r in registry.queries()[name](spark, SF).collect()]


def test_common_prefix_of_all_lengths(spark, con):  # noqa: F811
    pages = con.sql("select row_id, text, pymupdf_text from page_record where text is not null and pymupdf_text is not null").fetchall()
    assert max(len(a) for _, a, _ in pages) >= 1200
    assert sorted(rows(spark, "common_prefix")) == sorted((i, len(os.path.commonprefix([a, b]))) for i, a, b in pages)


def test_best_prefix_match_of_all_lengths(spark, tmp_path):
    long, short = "A long beginning of a page. " * 60, "Another beginning that two parses share. "
    texts = [(1, 1, long + "one"), (2, 1, long + "two"), (3, 1, "Nothing shared. " * 90), (4, 2, short + "a"), (5, 2, short + "b"), (6, 2, "x" * 2000), (7, 3, long), (8, 4, long), (9, 5, None), (10, 5, "")]
    page_record = spark.createDataFrame([(i, "d", page, t) for i, page, t in texts], "row_id long, document_id string, page int, text string")
    page_record.write.parquet(str(tmp_path / "page_record.parquet"))
    got = {tuple(r) for r in registry.queries()["best_prefix_match"](spark, str(tmp_path)).collect()}
    assert got == {(1, 2, len(long)), (2, 1, len(long)), (4, 5, len(short)), (5, 4, len(short))}


def test_plain_number(spark):
    values = {5.5: "5.5", 60.0: "60", 100.0: "100", 0.0: "0", 0.000401: "0.000401", 1e-7: "0.0000001", 2360000.0: "2360000", 12345.67: "12345.67", 1e15: "1000000000000000", 0.1 + 0.2: "0.300000000000000" + "04", -2.50: "-2.5", 1e300: "1.0E300"}
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert {r.v: r.s for r in df.select("v", T.plain_number(df.v).alias("s")).collect()} == values


def test_value_support_of_all_values(spark, con):  # noqa: F811
    claims = con.sql("select claim_id, value, unit, span from claim where value is not null and unit is not null and span is not null").fetchall()
    assert any(v != int(v) for _, v, _, _ in claims)

    def squeezed(t):
        return re.sub(r"[ \t\n\x0b\f\r]+", "", t).lower()

    expected = sorted((i, squeezed(f"{Decimal(repr(v)).normalize():f}{u}") in squeezed(s)) for i, v, u, s in claims)
    assert sorted(rows(spark, "value_support")) == expected


def test_band_lookup_of_all_orders(spark, con):  # noqa: F811
    regions = [r for r, in con.sql("select r_regionkey from region").fetchall()]
    expected = []
    for key, price in con.sql("select o_orderkey, o_totalprice from orders").fetchall():
        # bands are equally wide, so the first that holds the value is taken
        held = [r for r in sorted(regions) if r * 80000.0 <= price <= r * 80000.0 + 120000]
        expected += [(key, held[0])] if held else []
    assert sorted(rows(spark, "band_lookup")) == sorted(expected)


def test_mirror_repair_of_all_documents(spark, con):  # noqa: F811
    docs = con.sql("select doc_id, text, lang from documents where text is not null").fetchall()
    assert any(not t.isascii() for _, t, _ in docs) and any(lang != "en" for _, _, lang in docs)

    def score(t):
        return sum(w in L.COMMON_WORDS for w in re.findall("[a-z]{3,}", t.lower()))

    expected = []
    for i, t, _ in docs:
        t = t[::-1] if i % 2 == 0 else t
        expected.append((i, hashlib.md5((t[::-1] if len(t) >= 12 and score(t[::-1]) > score(t) else t).encode()).hexdigest()))
    assert sorted(rows(spark, "mirror_repair")) == sorted(expected)


def test_key_values_of_all_languages(spark, con):  # noqa: F811
    pattern = r"[0-9]+(?:\.[0-9]+)?(?: ?- ?[0-9]+(?:\.[0-9]+)?)? ?(?:mL/min/1\.73 m²|mg/mmol|mmol/L|mg/g|mmHg|g/L|mg|%|weeks|months|years|days)"
    expected = {}
    for i, t, _ in con.sql("select doc_id, text, lang from documents where text is not null").fetchall():
        for x in re.findall(pattern, t):
            at = (i, x.replace(" ", "").lower())
            expected[at] = min(x, expected.get(at, x))
    assert sorted(rows(spark, "key_values")) == sorted((i, k, x) for (i, k), x in expected.items())
