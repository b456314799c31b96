"""Web pages: forms and their fields, induction of the output path, URL filter. Nothing here opens a connection."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabweave.functions.text import TOKEN

#: Endings of addresses that a crawl of pages leaves out.
SKIPPED = ("css", "js", "bmp", "gif", "jpg", "jpeg", "png", "tif", "tiff", "mid", "mp2", "mp3", "mp4", "wav", "avi", "mov", "mpeg", "ram", "m4v", "pdf", "rm", "smil", "wmv", "swf", "wma", "zip", "rar", "gz")


class _Forms(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.rows: list[tuple] = []
        self.form, self.method = -1, ""
        self.inside = False
        self.path: list[str] = []
        self.texts: list[tuple[str, str]] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "form":
            self.form, self.inside, self.method = self.form + 1, True, (a.get("method") or "get").lower()
        elif self.inside and tag in ("input", "select", "textarea"):
            kind = (a.get("type") or "text").lower() if tag == "input" else tag
            self.rows.append((self.form, self.method, a.get("name") or "", kind))
        if tag not in ("input", "br", "img", "meta", "link", "hr"):
            self.path.append(tag)

    def handle_endtag(self, tag):
        if tag == "form":
            self.inside = False
        if tag in self.path:
            while self.path and self.path.pop() != tag:
                pass

    def handle_data(self, data):
        if data.strip():
            self.texts.append(("/" + "/".join(self.path), " ".join(data.split())))


def _parsed(html: str | None) -> _Forms:
    p = _Forms()
    try:
        p.feed(html or "")
    except (AssertionError, ValueError):
        pass
    return p


def forms(pages: DataFrame) -> DataFrame:
    """pages (page_id, html). (page_id, form, method, name, kind): the input fields of every form."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(k, *r) for k, h in zip(f["page_id"], f["html"]) for r in _parsed(h).rows], columns=["page_id", "form", "method", "name", "kind"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, form int, method string, name string, kind string")


def texts(pages: DataFrame) -> DataFrame:
    """(page_id, path, text): every text of a page with the path of its element."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(k, *r) for k, h in zip(f["page_id"], f["html"]) for r in _parsed(h).texts], columns=["page_id", "path", "text"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, path string, text string")


def induce_path(responses: DataFrame, least: int = 2) -> DataFrame:
    """responses (g, x, y, path, text): texts of the answer to x, where y is expected. (g, path, n): the path that shows y
    for most examples, the shortest texts first; accepted from `least` examples."""
    hit = responses.where(F.col("text").contains(F.col("y"))).groupBy("g", "path").agg(F.count_distinct("x").alias("n"), F.sum(F.length("text")).alias("len"))
    i = F.row_number().over(Window.partitionBy("g").orderBy(F.col("n").desc(), "len", "path"))
    return hit.withColumn("i", i).where((F.col("i") == 1) & (F.col("n") >= least)).select("g", "path", "n")


@dataclass(frozen=True)
class Wrapper:
    """A form of a page, the text input that takes the value, the submit field (for POST), and the path of the answer."""

    form: int
    method: str
    field: str
    submit: str
    path: str


def find_wrapper(html: str, examples: list[tuple[str, str]], send: Callable[[int, str, str, str, str], str], least: int = 2) -> Wrapper | None:
    """The first way to fill a form of the page that answers the examples (x, y): forms in their order, each text input, for
    POST each submit field; send(form, method, input, submit, x) gives the answering page. The path of the answer is the one
    that shows y for most examples, `least` at least, with the shortest texts. A page and a user's examples are few: this runs
    in the driver; the wrapper then runs over any number of values by through()."""
    rows = _parsed(html).rows
    for form in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == form]
        method = own[0][1]
        submits = [r[2] for r in own if r[3] == "submit"] if method == "post" else []
        for field in [r[2] for r in own if r[3] in ("text", "search", "textarea")]:
            for submit in submits or [""]:
                seen: dict[str, list[int]] = {}
                for x, y in examples:
                    for path, text in dict(reversed([t for t in _parsed(send(form, method, field, submit, x)).texts if y in t[1]])).items():
                        seen.setdefault(path, []).append(len(text))
                best = min(seen.items(), key=lambda p: (-len(p[1]), sum(p[1]), p[0]), default=None)
                if best and len(best[1]) >= least:
                    return Wrapper(form, method, field, submit, best[0])
    return None


def through(values: DataFrame, fetch: Callable[[str], str], paths: list[str]) -> DataFrame:
    """values (x). (x, y): each value sent through a wrapper; the text at the first of the paths that is there, or ''."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for x in f["x"]:
                found = dict(reversed(_parsed(fetch(x)).texts))
                out.append((x, next((found[p] for p in paths if p in found), "")))
            yield pd.DataFrame(out, columns=["x", "y"])

    return values.select("x").mapInPandas(run, "x string, y string")


def write_index(wrappers: DataFrame, path: str) -> None:
    """wrappers (wrapper, content, input_name, output_name) as one row per word of each field."""
    fields = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("content", "input_name", "output_name"))))
    words = wrappers.select("wrapper", fields.alias("x")).select("wrapper", "x.field", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("x.text"), F.lit(TOKEN), F.lit(0)))).alias("word"))
    words.distinct().sortWithinPartitions("word").write.parquet(path)


def search_index(index: DataFrame, content: str, input_name: str, output_name: str, most: int = 10) -> DataFrame:
    """(wrapper, n): the wrappers whose fields share most words with the query, the first `most`."""
    asked = [(f, w) for f, t in (("content", content), ("input_name", input_name), ("output_name", output_name)) for w in sorted(set(t.lower().split()))]
    q = index.sparkSession.createDataFrame(asked, "field string, word string")
    return index.join(F.broadcast(q), ["field", "word"]).groupBy("wrapper").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "wrapper").limit(most)


def wanted_url(url: Column) -> Column:
    """Whether a crawl follows the address."""
    return url.isNotNull() & ~F.lower(url).rlike(r"\.(" + "|".join(SKIPPED) + r")$")
