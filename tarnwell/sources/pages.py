"""Pages of markup files, read by several extractors side by side, and small choices of files and stages."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_BLOCKS = {"p", "div", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "br", "section", "article", "table"}


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs) -> None:
        self.hidden += tag in ("script", "style")
        if tag in _BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag: str) -> None:
        self.hidden -= tag in ("script", "style") and self.hidden > 0
        if tag in _BLOCKS:
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.out.append(re.sub(r"\s+", " ", data))


def by_blocks(markup: str) -> str:
    """Text in lines of block elements."""
    reader = _Reader()
    reader.feed(markup)
    return "\n".join(s for s in (x.strip() for x in "".join(reader.out).split("\n")) if s)


def by_tags(markup: str) -> str:
    """Text with tags taken out, in one line."""
    bare = re.sub(r"(?is)<(script|style)\b.*?</\1>|<[^>]*>", " ", markup)
    return re.sub(r"\s+", " ", html.unescape(bare)).strip()


EXTRACTORS: dict[str, Callable[[str], str]] = {"blocks": by_blocks, "tags": by_tags}


def read_pages(spark: SparkSession, path: str, extractors: dict[str, Callable[[str], str]] = EXTRACTORS) -> DataFrame:
    """(path, length, one text for each extractor): files under ``path``, one page each, as UTF-8.

    Any function of a page's markup can be an extractor; one that fails on a page gives null for it.  Files
    of no bytes give no row."""
    names = list(extractors)

    def attempt(f: Callable[[str], str], markup: str) -> str | None:
        try:
            return f(markup)
        except Exception:  # a page that one extractor can't read may be read by another
            return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            texts = [bytes(c).decode("utf-8", "replace") for c in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"], "length": pdf["length"]} | {n: [attempt(extractors[n], t) for t in texts] for n in names})

    files = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    return files.mapInPandas(run, "path string, length bigint, " + ", ".join(f"`{n}` string" for n in names))


def only_choice(given: str | None, present: list[str], shipped: str) -> str:
    """Which of several files is meant: the one that is named, else the shipped one, else the only one."""
    if given is not None:
        if given not in present:
            raise FileNotFoundError(given)
        return given
    if shipped in present:
        return shipped
    if len(present) == 1:
        return present[0]
    raise ValueError(f"name one of {sorted(present)}" if present else "nothing to choose from")


def run_stages(spark: SparkSession, folder: str, stages: dict[str, Callable[[dict[str, DataFrame]], DataFrame]], again: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Stages in order, each a table below ``folder`` made from those before it.

    A stage that is complete (it has Spark's success mark) is read, not run; ``again`` names stages to run
    all the same, and what follows a stage that was run is run, too."""
    done: dict[str, DataFrame] = {}
    fresh = False
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name, make in stages.items():
        mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/_SUCCESS")
        if fresh or name in again or not fs.exists(mark):
            make(done).write.mode("overwrite").parquet(f"{folder}/{name}")
            fresh = True
        done[name] = spark.read.parquet(f"{folder}/{name}")
    return done
