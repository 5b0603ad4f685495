"""Pages of markup, choices of files, stages that are not run twice, stored tables."""

import pytest

from tarnwell.sources import pages
from tarnwell.sources.store import stored
from tarnwell.sources.tables import read_json_array, write_index


def test_read_pages(spark, tmp_path):
    (tmp_path / "a.html").write_text("<h1>Title</h1><p>One &amp; two\n lines</p><script>x = 1 < 2</script><ul><li>a</li><li>b</li></ul>")
    (tmp_path / "b.html").write_text("<p>")
    (tmp_path / "c.html").write_text("")
    got = {r.path.rsplit("/", 1)[1]: (r.blocks, r.tags) for r in pages.read_pages(spark, str(tmp_path)).collect()}
    assert got == {"a.html": ("Title\nOne & two lines\na\nb", "Title One & two lines a b"), "b.html": ("", "")}
    failing = pages.read_pages(spark, str(tmp_path), {"none": lambda t: t[5]}).collect()
    assert {r.path.rsplit("/", 1)[1]: r.none for r in failing} == {"a.html": "i", "b.html": None}


def test_only_choice():
    assert pages.only_choice("x", ["x", "y"], "z") == "x" and pages.only_choice(None, ["y", "z"], "z") == "z" and pages.only_choice(None, ["y"], "z") == "y"
    with pytest.raises(FileNotFoundError):
        pages.only_choice("q", ["x"], "z")
    for present in (["x", "y"], []):
        with pytest.raises(ValueError):
            pages.only_choice(None, present, "z")


def test_run_stages(spark, tmp_path):
    ran = []

    def stage(name, make):
        def run(done):
            ran.append(name)
            return make(done)

        return run

    stages = {"one": stage("one", lambda d: spark.range(3)), "two": stage("two", lambda d: d["one"].selectExpr("id * 2 as x"))}
    assert [r.x for r in pages.run_stages(spark, str(tmp_path), stages)["two"].orderBy("x").collect()] == [0, 2, 4]
    pages.run_stages(spark, str(tmp_path), stages)
    assert ran == ["one", "two"]
    pages.run_stages(spark, str(tmp_path), stages, again=("one",))
    assert ran == ["one", "two", "one", "two"]


def test_stored_tables_are_built_once(spark, tmp_path):
    spark.range(4).write.parquet(str(tmp_path / "t"))
    built = []

    def build():
        built.append(1)
        return spark.read.parquet(str(tmp_path / "t")).selectExpr("id + 1 as id")

    source = spark.read.parquet(str(tmp_path / "t"))
    for _ in range(2):
        assert sorted(r.id for r in stored(spark, "t", [source], build, "id").collect()) == [1, 2, 3, 4]
    assert built == [1]
    spark.range(1).write.mode("append").parquet(str(tmp_path / "t"))
    assert stored(spark, "t", [spark.read.parquet(str(tmp_path / "t"))], build).count() == 5 and built == [1, 1]


def test_read_json_array_and_index(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1,\n "b": "x"}, {"a": 2}]')
    assert [(r.a, r.b) for r in read_json_array(spark, str(tmp_path / "a.json"), "a int, b string").orderBy("a").collect()] == [(1, "x"), (2, None)]
    write_index(spark.range(2), str(tmp_path / "i"))
    write_index(spark.range(3), str(tmp_path / "i"))
    assert spark.read.parquet(str(tmp_path / "i")).count() == 3
    with pytest.raises(Exception, match="(?i)exists"):
        write_index(spark.range(1), str(tmp_path / "i"), experiment=True)
