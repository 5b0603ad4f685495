"""Operators for training data: small fixtures, defined edge cases, brute force at the smallest scale."""

import itertools
import re
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tarnwell.llm import lookalike, neardup, overlap, packing, pages, queries, ranking, sentences, split, tokens
from tarnwell.llm.texts import WORD, items
from tests.test_oracle import SF, con, same  # noqa: F401

TEXTS = "src string, id long, text string, canonical string, u long"


def texts(spark, *values, src="page_record"):
    """Rows with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(src, i, v, "x", -1) for i, v in enumerate(values)], TEXTS)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, con, name):  # noqa: F811
    same(spark, con, name, queries.queries()[name], queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_runs_on_all_rows(spark, name):
    assert queries.queries()[name](spark, SF).count() >= 0


NULLS = [None, "", " ", "a b c", "a b c"]


def test_nulls_in_any_column(spark):
    """Keys, groups and texts may be null in every operator."""
    t = spark.createDataFrame([(s, i, x) for s in (None, "s") for i in (None, 2**60 + 1) for x in [*NULLS, "word " * 600]], "src string, id long, text string")
    assert {r.id for r in split.split_oversized(t).collect()} == {None, 2**60 + 1}
    rules = lookalike.rules_for(t)
    assert lookalike.canonical(t, rules).count() == t.count()
    assert lookalike.show_alike(t, rules).count() == 0
    assert all(r.id_a is not None for r in neardup.near_pairs(t).collect())
    q = spark.createDataFrame([(g, i, v, v) for g in (None, "q") for i in (None, "i") for v in (None, 1.0)], "q string, i string, a double, b double")
    assert ranking.median_ranks(q, "q", "i", {"a": 1.0, "b": 1.0}, positions=True).count() == 2
    o = spark.createDataFrame([(s, None, k, x) for s in (None, "dev", "test") for k in (None, 1) for x in NULLS], "slice string, source string, key long, text string")
    assert {(r.train_key, r.eval_key) for r in overlap.overlaps(o).collect()} == {(1, 1)}
    p = spark.createDataFrame([(i, None, g, x, x, None) for i in (None, 2**60 + 1) for g in (None, 3) for x in [*NULLS, PAGE]], "row_id long, title string, page int, text string, pymupdf_text string, pdfplumber_text string")
    fields = ["text", "pymupdf_text", "pdfplumber_text"]
    assert {r.row_id for r in pages.notes(p, fields, {"people": 9}, pages.Forms(frozenset(), frozenset(["- # -"]))).collect()} == {None, 2**60 + 1}
    assert pages.repair(p, fields, {}, pages.Forms(frozenset())).count() == 3 * p.count()
    d = spark.createDataFrame([(i, x) for i in (None, 2**60 + 1) for x in NULLS], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.ids) for r in tokens.encode(d).collect())[-1][0] == 2**60 + 1
    packed = packing.pack(tokens.lengths(d)).collect()
    assert len(packed) == d.count() and {r.doc_id for r in packed} == {None, 2**60 + 1}
    assert {r.doc_id for r in sentences.split(d, sentences.learn(d)).collect()} == {None, 2**60 + 1}


# 1


def checked(text, limit=2000, lap=200):
    ps = split.pieces(text, limit, lap)
    assert "".join(text[a:b] for _, a, b, _ in ps) == text
    for (h, a, b, _), before in zip(ps, [None, *ps], strict=False):
        assert b - h <= limit and 0 <= a - h <= lap and (before is None) == (h == 0 or a == 0 or before is None)
        assert before is None or h >= before[0]
    return ps


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n!#1  。", max_size=400))
def test_pieces_part_the_text(t):
    ps = checked(t, 40, 10)
    long_run = any(len(x) > 40 for x in re.split(r"[\s.!?。！？]", t))
    if len(t) > 40:
        assert any(p[3] == split.FORCED for p in ps) == long_run


def test_split_kinds(spark):
    body = "A sentence of some words here. " * 200
    cases = ["short", None, "", body, "x" * 5000, "word " * 700, ("line of words without a stop\n" * 120), "1.1 Heading\n\n" + body]
    got = {}
    for r in split.split_oversized(texts(spark, *cases)).collect():
        got.setdefault(r.id, []).append(r)
    assert set(got) == {3, 4, 5, 6, 7}
    assert {r.ends_with for r in got[4][:-1]} == {"forced"} and {r.ends_with for r in got[3][:-1]} == {"sentence"}
    assert {r.ends_with for r in got[5][:-1]} == {"word"} and {r.ends_with for r in got[6][:-1]} == {"line"}
    kinds = {r.row_id: r.kind for r in split.oversized(texts(spark, *cases)).collect()}
    assert kinds[4] == "forced" and kinds[3] == "boundary"
    assert split.oversized(texts(spark).limit(0)).count() == 0
    checked("word" * 499 + "abcd." + "y" * 2000 + "." + " " * 3000)


def test_list_items_and_markup_are_nodes():
    items = [f"- item {k} begins here\n  and goes on with {'words ' * 12}to its end\n" for k in range(8)]
    text = "Intro line\n" + "".join(items)
    for h, a, b, kind in split.pieces(text, 260, 0):
        assert a == 0 or text[a:].startswith("- item")  # an item that fits is never torn
    assert split._level("<h2>Title</h2>", 0, 14) == 2 and split._level("Kapitel 3", 0, 9) == 0 and split._level("3.1 Scope", 0, 9) == 2
    marked = "<p>" + "one two. " * 12 + "</p><p>" + "three four. " * 9 + "</p>"
    assert [marked[a:b].startswith("<p>") for _, a, b, _ in split.pieces(marked, 130, 0)] == [True, True]


# 2


def shown(s):
    out = []
    looks = {a: b for k, v in lookalike.LOOKS.items() for a, b in zip(k, v)}
    for c in s:
        if unicodedata.category(c) == "Cf":
            continue
        out.append(" " if c.isspace() and c not in "\n\t\r" else looks.get(c, c))
    return unicodedata.normalize("NFC", "".join(out))


def rewriter(*ts):
    counts = {}
    for c in "".join(ts):
        counts[c] = counts.get(c, 0) + 1
    return lookalike.Rewriter(lookalike.build_rules(counts))


def test_same_look_same_form():
    plain = "The café offers fine coffee to Anna, 12 µg."
    odd = ["The café offers fine coffee to Anna, 12 µg.", "Тhe café оffers fine сoffee to Аnna, 12 μg.", "The​ cafe­́ offers ﬁne coﬀee to Anna, 12 µg.", "Ｔｈｅ café offers fine coffee to Anna, １２ µg."]
    w = rewriter(plain * 50, *odd)
    assert {w(x) for x in odd} == {w(plain)} == {plain}
    for other in ("The cafe offers fine coffee to Anna, 12 µg.", "the café offers fine coffee to Anna, 12 µg.", "The café offers fine coffee to Anna; 12 µg.", "The café offers fine coffee to Anna, 1² µg."):
        assert w(other) != plain


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aеoοiі é́ê̂ñ​­ ﬁﬂ２2²Ａμµ\n", max_size=30))
def test_form_is_stable(t):
    w = rewriter("aeio" * 30 + " 2", t)
    assert w(w(t)) == w(t)
    lazy = lookalike.LazyRewriter()
    lazy.meet([t])
    assert lazy(lazy(t)) == lazy(t)


def test_show_alike_edges(spark):
    t = texts(spark, "a b", "a b", "a b", None, "", " ", "​", "A b", "a b", "а b")
    got = {tuple(r) for r in lookalike.show_alike(t, lookalike.rules_for(t)).collect()}
    ids = [0, 1, 2, 8, 9]
    raw = {0: "a b", 1: "a b", 2: "a b", 8: "a b", 9: "а b"}
    assert got == {("page_record", i, j) for i, j in itertools.combinations(ids, 2) if raw[i] != raw[j]}
    assert lookalike.show_alike(t.limit(0), lookalike.rules_for(t.limit(0))).count() == 0
    forms = lookalike.canonical(t, lookalike.rules_for(t)).collect()
    assert forms[3].canonical is None and forms[4].canonical == ""


# 3


def scores(spark, *rows):
    return spark.createDataFrame([(q, i, a, b, "clash") for q, i, a, b in rows], "q string, i string, a double, b double, g string")


def test_median_ranks_both_ways(spark):
    rows = [("q", f"i{k:03}", float(k % 7), None if k % 5 == 0 else k * 1000.0) for k in range(60)] + [("r", "x", None, None), ("r", "y", float("nan"), 1.0), ("r", "y", 2.0, 1.0), (None, "z", 1.0, 1.0)]
    df = scores(spark, *rows)
    w = {"a": 1.0, "b": 2.0}
    plain = {tuple(r) for r in ranking.median_ranks(df, "q", "i", w, positions=True).select("q", "i", "median_rank", "mean_rank", "n_scores", "position").collect()}
    hot = {tuple(r) for r in ranking.median_ranks(df, "q", "i", w, positions=True, hot_rows=10).select("q", "i", "median_rank", "mean_rank", "n_scores", "position").collect()}
    assert plain == hot and len(plain) == 63
    assert ranking.median_ranks(df.limit(0), "q", "i", w).count() == 0
    firsts = {r.q: r.i for r in ranking.first_of(ranking.median_ranks(df, "q", "i", w), "q", "i", 2).collect()}
    assert firsts["r"] == "y"


def test_scale_does_not_matter(spark):
    rows = [("q", c, x, y) for c, x, y in (("a", 0.9, 10.0), ("b", 0.8, 999999.0), ("c", 0.1, 5.0), ("d", 0.85, 11.0))]
    wide = [(q, i, a, b * 1e6 + 5) for q, i, a, b in rows]
    for r in (rows, wide):
        order = [x.i for x in ranking.median_ranks(scores(spark, *r), "q", "i", {"a": 1.0, "b": 1.0}, positions=True).orderBy("position").collect()]
        assert order == ["a", "b", "d", "c"] or order[0] in "abd"


# 4


def splits(spark, *rows):
    return spark.createDataFrame([(s, "t", k, x, "clash", []) for k, (s, x) in enumerate(rows)], "slice string, source string, key long, text string, cls string, words array<string>")


def test_overlap_against_brute_force(spark):
    base = "at what level should the guideline stop drug alpha and offer drug beta instead".split()
    rows = [("dev", " ".join(base)), ("test", " ".join(base)), ("test", " ".join(base[::-1])), ("heldout", " ".join(base[:10])), ("heldout", " ".join(base[:6])), ("dev", None), ("test", None), ("test", ""), ("dev", "!!"), ("dev", " ".join(base + ["now"])), ("test", "other words only")]
    rows += [("dev", " ".join(base))] * 3
    sets = [set(WORD.findall((t or "").lower())) for _, t in rows]
    for block in (5_000, 2):  # with and without words split into blocks
        found = overlap.overlaps(splits(spark, *rows), block=block).collect()
        got = {(r.train_key, r.eval_key) for r in found}
        assert len(found) == len(got) and {(r.train_key, r.eval_key): r.coverage for r in found}[0, 1] == 1.0
        want = {(i, j) for i, j in itertools.product(range(len(rows)), repeat=2) if rows[i][0] == "dev" and rows[j][0] != "dev" and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.7 * len(sets[i] | sets[j])}
        assert got == want
    rep = {(r.slice): r for r in overlap.report(splits(spark, *rows)).collect()}
    assert rep["test"].records == 3 and rep["test"].overlapping == 2 and rep["test"].exact == 2 and 0 < rep["test"].mean_coverage < 1
    assert overlap.overlaps(splits(spark, ("test", "a b"))).count() == 0
    assert overlap.overlaps(splits(spark).limit(0)).count() == 0


# 5


def brute(values, threshold):
    form = lookalike.LazyRewriter()
    form.meet([v for v in values if v])
    s = [set(WORD.findall(form(v).lower())) if v else set() for v in values]
    return {(i, j) for i, j in itertools.combinations(range(len(s)), 2) if s[i] and s[j] and len(s[i] & s[j]) >= threshold * len(s[i] | s[j])}


def test_near_pairs_edges(spark):
    base = [f"word{k}" for k in range(40)]
    values = [" ".join(base), " ".join(base), " ".join(base[::-1]), " ".join(base[:38] + ["x", "y"]), " ".join(base[:20]), None, "", "...", "one", "one", "Оne"]
    got = {(r.id_a, r.id_b) for r in neardup.near_pairs(texts(spark, *values), words=1, threshold=0.7, weights="unit").collect()}
    assert got == brute(values, 0.7)
    assert neardup.near_pairs(texts(spark).limit(0)).count() == 0


def test_crowded_bucket_loses_nothing(spark, monkeypatch):
    base = [f"word{k}" for k in range(60)]
    values = [" ".join(base[:k] + [f"odd{k}"] + base[k + 1 :]) for k in range(25)]
    t = texts(spark, *values)
    every = neardup.sets(t, 1).selectExpr("id as num", "u", "code", "words", "tfs")
    df, n = neardup.document_frequencies(neardup.sets(t, 1))
    for weights in ("unit", "tfidf"):
        got = {(min(r.a, r.b), max(r.a, r.b)) for r in neardup.candidates(every, df, n, 0.7, 20, 2, weights, bucket=4, salt=3).collect()}
        assert got >= brute(values, 0.7)


def test_meeting_keeps_all_when_it_passes_on(spark, monkeypatch):
    base = [f"word{k}" for k in range(60)]
    values = [" ".join(base[:k] + [f"odd{k}"] + base[k + 1 :]) for k in range(25)] + [" ".join(f"other{j}x{k}" for j in range(30)) for k in range(10)] * 2
    monkeypatch.setattr(neardup, "MET", 50)
    monkeypatch.setattr(neardup, "PACKED", 7)
    got = {(r.id_a, r.id_b) for r in neardup.near_pairs(texts(spark, *values), words=1, threshold=0.7, weights="unit", bands=20, rows=2).collect()}
    assert got == brute(values, 0.7)


def test_packed_hashes():
    x = np.sort(np.random.default_rng(1).integers(0, 1 << 48, 300).astype(np.uint64))
    assert (neardup.unpacked(neardup.packed(x)) == x).all() and len(neardup.unpacked(b"")) == 0


def test_byte_bound_never_drops_a_pair(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(300):
        a = set(rng.integers(0, 1 << 48, 40).tolist())
        b = set(list(a)[: int(rng.integers(20, 40))]) | set(rng.integers(0, 1 << 48, int(rng.integers(0, 12))).tolist())
        rows.append((k, -k, bytearray(x & 255 for x in a), bytearray(x & 255 for x in b), len(a & b) / len(a | b)))
    df = spark.createDataFrame(rows, "a long, b long, bytes_a binary, bytes_b binary, j double")
    kept = {r.a for r in neardup._bounded(df, 0.7).collect()}
    assert kept >= {r[0] for r in rows if r[4] >= 0.7} and len(kept) < 300


def test_near_groups(spark):
    base = [f"word{k}" for k in range(40)]
    values = [" ".join(base), " ".join(base), " ".join(base[:39] + ["x"]), "alone in here", None]
    got = {r.id: (r.class_id, r.links) for r in neardup.near_groups(texts(spark, *values), words=1, threshold=0.7, weights="unit").collect()}
    assert got[0] == got[1] and got[0][1] == 2 and got[2][1] == 2 and got[2][0] == got[0][0] and got[3][1] == 0 and 4 not in got


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (101, 102), (7, 200)]
    df = spark.createDataFrame(edges + [(b, a) for a, b in edges], "a long, b long")
    got = {r.u: r.label for r in neardup.components(df).collect()}
    assert {got[k] for k in [*range(1, 41), 200]} == {1} and {got[100], got[101], got[102]} == {100}


def test_weighted_default_on_five_words(spark):
    base = [f"word{k}" for k in range(120)]
    values = [" ".join(base), " ".join(base[:60] + ["odd"] + base[61:]), " ".join(base[:30])]
    got = {(r.id_a, r.id_b) for r in neardup.near_pairs(texts(spark, *values)).collect()}
    assert got == {(0, 1)}


# 7


PAGE = "Harbour Kidney Board    12\n\nPeople with anaemia were treated with the new programme and the com-\nmittee judged the long-\nterm outcome. The programrne was stopped bec­\nause of cost.\n\nTable 1. values\nName | 1 | 2\n45\nOther | 3 | 4\n\n- 12 -"


def page_rows(spark, *values):
    return spark.createDataFrame([(i, "A title", 12, v, v, None, "clash") for i, v in enumerate(values)], "row_id long, title string, page int, text string, pymupdf_text string, pdfplumber_text string, fld string")


def test_page_notes(spark):
    lexicon = {"people": 500, "programme": 400, "committee": 300, "because": 300, "long-term": 90, "stopped": 100, "term": 50, "long": 60, "outcome": 80, "judged": 80, "anaemia": 90}
    forms = pages.Forms(frozenset(["harbour kidney board"]), frozenset(["~p    #", "- # -"]))
    confused = [("m", "rn"), ("rn", "m")]
    fields = ["text", "pymupdf_text", "pdfplumber_text"]
    rows = page_rows(spark, PAGE, None, "", "   \n ", "x" * 50_000)
    got = {(r.line_no, r.kind) for r in pages.notes(rows, fields, lexicon, forms, confused).where("row_id = 0 and fld = 'text'").collect()}
    assert got == {(1, "furniture"), (3, "break"), (5, "misread"), (5, "break"), (13, "furniture")}
    assert pages.notes(rows, fields, lexicon, forms, confused).where("row_id between 1 and 3").count() == 0
    fixed = {(r.row_id, r.fld): r.repaired for r in pages.repair(rows, fields, lexicon, forms, confused).collect()}
    assert fixed[0, "text"].startswith("People with anaemia were treated with the new programme and the committee judged the long-term outcome. The programme was stopped because of cost.")
    assert "12" not in fixed[0, "text"].split("Table")[0] and fixed[1, "text"] is None and fixed[2, "text"] == ""
    assert pages.notes(rows.limit(0), fields, lexicon, forms, confused).count() == 0


def test_misreadings_do_not_depend_on_size(spark):
    fields = ["text", "pymupdf_text", "pdfplumber_text"]
    rows = page_rows(spark, "Most pe0ple were seen.\nOther people were not.\nSome peop1e left theirpeople there.")
    lexicon = {"people": 32_338, "pe0ple": 157, "peop1e": 146, "most": 9_000, "were": 90_000, "seen": 2_000, "other": 9_000, "not": 50_000, "some": 9_000, "left": 2_000, "their": 20_000, "there": 5_000}
    for scale in (1, 10, 1000):
        larger = {w: n * scale for w, n in lexicon.items()}
        got = {(r.line_no, r.kind) for r in pages.notes(rows, fields, larger, pages.Forms(frozenset()), [("o", "0"), ("l", "1")]).where("fld = 'text'").collect()}
        assert got == {(1, "misread"), (3, "misread")}
        assert pages.repair(rows, fields, larger, pages.Forms(frozenset()), [("o", "0"), ("l", "1")]).where("fld = 'text'").first().repaired == "Most people were seen. Other people were not. Some people left their people there."


def test_learn(spark):
    rows = page_rows(spark, PAGE, PAGE, None, "").selectExpr("*", "concat('d', row_id) as document_id")
    got, forms = pages.learn(rows, ["text", "pymupdf_text", "pdfplumber_text"], frozenset(["harbour kidney board"]))
    assert got["people"] == 2 and "com" not in got and "mittee" not in got and got["the"] == 8
    assert {"~p    #", "- # -"} <= forms.known and not any("people" in f for f in forms.known if f.startswith("name"))
    empty = pages.learn(rows.limit(0), ["text"], frozenset())
    assert empty[0] == {} and empty[1].known == frozenset()


def test_furniture_recurs_over_documents(spark):
    """A form at the edges of pages of several documents is furniture; body lines and forms inside pages aren't."""
    def page(k):
        return f"Northern Board – part {k}\n\nThe {'abcdefghij'[k]}{'xyzuvwrstq'[k]} group met.\nPoint {k}.2:\nMore {'klmnopqrst'[k]}{'abcdefghij'[k]} text stands here.\n\n{k}"

    values = [(k, f"d{k}", f"Care of {'abcdefghij'[k]}: first edition", k, page(k)) for k in range(10)]
    rows = spark.createDataFrame(values, "row_id long, document_id string, title string, page int, text string")
    _, forms = pages.learn(rows, ["text"], frozenset(["northern board"]))
    assert "~p – part #" in forms.known and "point #.#:" not in forms.known
    got = {(r.row_id, r.line_no) for r in pages.notes(rows, ["text"], {}, forms).where("kind = 'furniture'").collect()}
    assert got == {(k, n) for k in range(10) for n in (1, 7)}
    doubled = rows.unionByName(rows)
    assert pages.learn(doubled, ["text"], frozenset(["northern board"]))[1].known == forms.known


def test_confusions_are_learnt_and_doubling_changes_nothing():
    words = ["people", "pressure", "programme", "prescribe", "perfect", "chemical", "measure", "evidence", "exercise", "severe"]
    counts = {w: 5000 + k for k, w in enumerate(words)} | {"bed": 4000, "bad": 3900}
    counts |= {w[:k] + "c" + w[k + 1 :]: 3 for w in words for k, c in enumerate(w) if c == "e"}
    confused = pages.confusions(counts)
    assert confused == [("c", "e"), ("e", "c")]
    twice = {w: 2 * n for w, n in counts.items()}
    assert pages.confusions(twice) == confused
    one, two = pages.Lexicon(counts), pages.Lexicon(twice)
    for stretch in ([("pcople", " ")], [("mca", "-"), ("sure", " ")], [("severeexercise", " ")], [("evi", " "), ("dence", " ")], [("severe", "-"), ("exercise", " ")], [("pressurcexer", "-"), ("cise", " ")], [("unknowable", " ")]):
        assert one.decode(stretch) == two.decode(stretch)
    assert [s[3:] for s in one.decode([("pcople", " ")])] == [("read", "people")]
    assert [s[3:] for s in one.decode([("mca", "-"), ("sure", " ")])] == [("join", "measure")]
    assert [s[3:] for s in one.decode([("severeexercise", " ")])] == [("piece", "severe"), ("piece", "exercise")]
    assert [s[3:] for s in one.decode([("evi", " "), ("dence", " ")])] == [("merge", "evidence")]
    # run together and cut over a line end at once
    assert [s[3:] for s in one.decode([("pressurccxer", "-"), ("cise", " ")])] == [("piece", "pressure"), ("join", "exercise")]


# 8


@pytest.fixture(scope="module")
def both():
    import base64

    import public_tokenizers as P
    import tiktoken

    path = tokens.rank_file()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tokens.automaton(path), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(t=st.text(max_size=60))
def test_encoding_equals_merges(both, t):
    t = t.encode("utf-8", "replace").decode()
    a, other = both
    assert a.encode(t) == other.encode_ordinary(t) and a.decode(a.encode(t)) == t and a.count(t) == len(a.encode(t))


def test_encoding_of_long_runs(both):
    a, other = both
    for t in ("a" * 3000, "ab" * 3000, "the " * 2000, " " * 500 + "x", "<|endoftext|>", "\n\n \t x", "漢字" * 900):
        assert a.encode(t) == other.encode_ordinary(t)


def test_encode_rows(spark, both):
    df = spark.createDataFrame([(1, "hello world", 5), (2, None, 5), (3, "", 5), (3, "", 5)], "doc_id long, text string, ids int")
    got = sorted((r.doc_id, r.ids) for r in tokens.encode(df).collect())
    assert got == [(1, both[1].encode_ordinary("hello world")), (2, []), (3, []), (3, [])]
    assert tokens.encode(df.limit(0)).count() == 0
    assert {r.doc_id: r.text for r in tokens.decode(tokens.encode(df)).collect()} == {1: "hello world", 2: "", 3: ""}


# 9


def test_best_fit_keeps_capacities():
    import numpy as np

    rng = np.random.default_rng(1)
    sizes = np.sort(rng.integers(1, 2048, 3000))[::-1]
    for norm in (False, True):
        where = packing.best_fit(sizes, 2048, 16, 3_000_000, norm=norm)
        for n in range(where.max() + 1):
            own = sizes[where == n]
            assert own.sum() <= 2048 and len(own) <= 16 and (own.astype(float) ** 2).sum() <= max(3_000_000, own[0] ** 2)
    where = packing.best_fit(sizes, 2048, 256)
    assert sizes.sum() / (2048 * (where.max() + 1)) > 0.95


def test_pack_rows(spark):
    df = spark.createDataFrame([(1, 5000, "x"), (2, 100, "x"), (3, 0, "x"), (4, None, "x"), (5, 2048, "x"), (6, 1948, "x")], "doc_id long, n_tokens long, container string")
    rows = packing.pack(df).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert sorted(r.n_tokens for r in by[1]) == [904, 2048, 2048] and by[3][0].container is None and by[4][0].container is None
    use = {}
    for r in rows:
        if r.container is not None:
            use[r.container] = use.get(r.container, 0) + r.n_tokens
    assert max(use.values()) <= 2048 and by[2][0].container == by[6][0].container
    assert packing.pack(df.limit(0)).count() == 0
    assert packing.fill(packing.pack(df)).collect()[0].n_tokens == 9096


# 10


POOL = [
    "Dr. Smith saw it.", 'The leaflet asks "Is it safe?" before use.', "Options include salt, etc.", "He went at 8 a.m.", "The next day came.", "The value was 3.5 mg.", "It fell.", "See Fig. 3 for more.",
    "All was well.", "Prof. Jones agreed with Dr. Smith.", "Am 7. Mai kam Dr. Meier.", "Es war gut usw.", "Am 8. Mai ging er.", "Er blieb.", "She left in 2012.", "It rose to 17.", "They met Mr. Brown.",
]


def paragraphs(n, seed=5):
    import random

    r = random.Random(seed)
    return ["\n\n".join(" ".join(r.choice(POOL) for _ in range(r.randint(1, 5))) for _ in range(4)) for _ in range(n)]


CORPUS = paragraphs(300)


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(CORPUS)], "doc_id long, text string")
    return sentences.learn(docs)


def cut(text, model):
    out, at = [], 0
    for e in sentences.ends(text, sentences.Model(model)):
        out.append(text[at:e].strip())
        at = e
    return out


def test_sentences(model):
    assert cut("Dr. Smith saw it. The end came.", model) == ["Dr. Smith saw it.", "The end came."]
    assert cut('He asks "Is it safe? Or not." before use. It is.', model) == ['He asks "Is it safe? Or not." before use.', "It is."]
    assert cut('The note said: "Call him." The end.', model) == ['The note said: "Call him."', "The end."]
    assert cut("It was 3.5 mg. See Fig. 3 now.", model) == ["It was 3.5 mg.", "See Fig. 3 now."]
    assert cut("Salt, etc. The rest was lost.", model) == ["Salt, etc.", "The rest was lost."]
    assert cut("Am 7. Mai kam er. Es war gut.", model) == ["Am 7. Mai kam er.", "Es war gut."]
    assert cut("请停药。护士说：“好。”然后走了。真的吗？", model) == ["请停药。", "护士说：“好。”然后走了。", "真的吗？"]
    assert cut("看護師は「安全ですか。」と尋ねた。次。", model) == ["看護師は「安全ですか。」と尋ねた。", "次。"]
    assert cut("यह ठीक है। वह गया।", model) == ["यह ठीक है।", "वह गया।"]
    assert cut("A line\nbreak only. Next\none.\n \nBlank ends it\n\nDone", model) == ["A line\nbreak only.", "Next\none.", "Blank ends it", "Done"]
    assert cut("1.2 Heading here\n\n1. First item. With two.\n2. Second\nwrapped item\n\n- a\n- b", model) == ["1.2 Heading here", "1. First item. With two.", "2. Second\nwrapped item", "- a", "- b"]
    assert cut("It fell.The next rose.", model) == ["It fell.", "The next rose."]


def test_held_out_paragraphs(model):
    """Paragraphs of the same sentences in other order: every boundary is known."""
    for t in paragraphs(60, seed=6):
        want = [s for p in t.split("\n\n") for s in _sentences_of(p)]
        assert cut(t, model) == want


def _sentences_of(p):
    out = []
    while p:
        s = max((x for x in POOL if p.startswith(x)), key=len)
        out.append(s)
        p = p[len(s) :].lstrip()
    return out


@settings(max_examples=150, deadline=None)
@given(t=st.text(alphabet="aB .!?\n\"«»(1。", max_size=60))
def test_sentences_cover_the_text(model, t):
    ends = sentences.ends(t, sentences.Model(model))
    assert ends == sorted(set(ends)) and all(not t[e - 1].isspace() for e in ends)
    assert bool(ends) == bool(t.strip()) and (not ends or not t[ends[-1] :].strip())


def test_split_rows(spark, model):
    df = spark.createDataFrame([(1, "It was. He left.", 9), (2, None, 9), (3, "", 9), (4, " \n ", 9)], "doc_id long, text string, end_pos int")
    assert sorted((r.doc_id, r.end_pos) for r in sentences.split(df, model).collect()) == [(1, 7), (1, 16)]
    empty = df.limit(0)
    assert sentences.split(empty, sentences.learn(empty)).count() == 0


def test_slices_are_bounded_and_whole():
    import pyarrow as pa

    from tarnwell.llm.texts import slices

    b = pa.RecordBatch.from_pydict({"k": list(range(9)), "t": ["a" * n for n in (5, 5, 50, 0, 1, 9, 9, 9, 9)]})
    got = list(slices(b, [1], rows=4, size=20))
    assert [r for s in got for r in s.column(0).to_pylist()] == list(range(9))
    assert all(s.num_rows <= 4 and (s.num_rows == 1 or sum(map(len, s.column(1).to_pylist())) <= 20) for s in got)
    assert list(slices(b.slice(0, 0), [1])) == []


def test_items_keep_all_rows(spark):
    assert items(spark, SF, "page_record", "question_sample2").count() == spark.read.parquet(f"{SF}/page_record.parquet").count() + spark.read.parquet(f"{SF}/question_sample2.parquet").count()


def test_sentences_of_unpunctuated_text(spark):
    """Sentences seen with marks in the corpus are found in text without any."""
    people, does, what = ["patients", "nurses", "families"], ["should measure", "often report", "must record"], ["blood pressure at home", "urinary protein each month", "body weight in the morning"]
    lines = [f"The {p} {d} {w}." for p in people for d in does for w in what]
    solid = ["血圧を測定する。", "患者に説明する。", "薬を減量する。", "尿蛋白を調べる。"]
    docs = spark.createDataFrame([(k, " ".join(lines[k % 9 :] + lines[: k % 9])) for k in range(60)] + [(100 + k, "".join(solid[k % 4 :] + solid[: k % 4])) for k in range(60)], "doc_id long, text string")
    model = sentences.Model(sentences.learn(docs))
    for parts, sep in ([lines[3][:-1].lower(), lines[10][:-1].lower(), lines[22][:-1].lower()], " "), ([s[:-1] for s in solid], ""):
        text = sep.join(parts)
        ends, at = [], 0
        for p in parts:
            at = text.index(p, at) + len(p)
            ends.append(at)
        assert sentences.ends(text, model) == ends


def test_posteriors_against_all_labelings():
    odds, near = [0.4, -1.0, 2.0, 0.1, -0.3], [False, True, True, False, True]
    short = 2.718281828459045**-2.0
    total, at = 0.0, [0.0] * 5
    for labels in itertools.product((0, 1), repeat=5):
        p = 1.0
        for k, y in enumerate(labels):
            q = 1 / (1 + 2.718281828459045 ** -odds[k])
            p *= q if y else 1 - q
            if y and near[k] and labels[k - 1]:
                p *= short
        total += p
        for k, y in enumerate(labels):
            at[k] += p * y
    assert sentences.posteriors(odds, near) == pytest.approx([x / total for x in at])


def test_hot_null_group_is_ranked_alike(spark):
    rows = [(g, f"i{k % 40:02}", float(k * 7 % 23), float(k * 5 % 11) if k % 3 else None) for g in (None, "q") for k in range(60)]
    df = spark.createDataFrame(rows, "g string, item string, a double, b double")
    usual = {tuple(r) for r in ranking.median_ranks(df, "g", "item", {"a": 1.0, "b": 1.0}, positions=True).collect()}
    for limit in (10, 0):
        assert {tuple(r) for r in ranking.median_ranks(df, "g", "item", {"a": 1.0, "b": 1.0}, positions=True, hot_rows=limit).collect()} == usual
    assert {r[0] for r in usual} == {None, "q"}


def test_many_accents_reach_a_stable_form():
    w = lookalike.Rewriter(lookalike.build_rules(lookalike.usual_counts({chr(c) for c in range(0x20, 0x370)})))
    text = "a" + "́̀̂" * 20 + "b"
    assert w(w(text)) == w(text)
