"""Company milestones from HTML pages.

A small parser turns a page into rows of its tree, in Arrow batches: elements in order, each with its parent, the last
element inside it, and which of the page's strings are its own.  Everything else is columns over those arrays: where
the section is, the lists, tables and paragraphs near it, labels of script timelines, and else all lines with a year.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import history_year, squash, strip_accents
from ..session import release

#: Fixed names and patterns of the section.
TITLE, CONTAINER, BODY, SAYS = "company-history__header-title", "company-history__container", "company-history__body", "moc lich su"
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
TITLED = [*HEADINGS, "strong", "b", "div", "span", "p"]
CATEGORIES = r"(?s)_categories\s*=\s*\[(.*?)\]"
DATE = r"(?U)\b(\d{1,2}[/-]\d{1,2}[/-](?:19|20)\d{2})\b"
MOST_SIBLINGS, LEAST_CHARS = 15, 8
#: Pages whose trees a worker holds at once.
SLICE = 32

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
PAGE = "nodes array<struct<tag: string, classes: array<string>, parent: int, last: int, low: int, high: int>>, strings array<string>, scripts array<string>"


class _Tree(HTMLParser):
    """Elements as [tag, classes, parent, last element inside, first string, end of strings]; parent -1 is the page."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.nodes, self.strings, self.scripts, self.open = [], [], [], []
        self.feed(page)
        self.close()
        self._end(0)

    def _end(self, depth: int) -> None:
        for i in self.open[depth:]:
            self.nodes[i][3], self.nodes[i][5] = len(self.nodes) - 1, len(self.strings)
        del self.open[depth:]

    def handle_starttag(self, tag, attrs):
        at = len(self.nodes)
        self.nodes.append([tag, (dict(attrs).get("class") or "").split(), self.open[-1] if self.open else -1, at, len(self.strings), len(self.strings)])
        if tag not in VOID:
            self.open.append(at)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        depth = next((d for d in range(len(self.open) - 1, -1, -1) if self.nodes[self.open[d]][0] == tag), None)
        if depth is not None:
            self._end(depth)

    def handle_data(self, data):
        within = self.nodes[self.open[-1]][0] if self.open else ""
        if within == "script":
            self.scripts.append(data)
        elif within != "style" and data.strip():
            self.strings.append(data.strip())


def trees(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, nodes, strings, scripts) of each page; a null page has none."""
    names = ("tag", "classes", "parent", "last", "low", "high")
    node = pa.struct([("tag", pa.string()), ("classes", pa.list_(pa.string())), *[(n, pa.int32()) for n in names[2:]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for whole in batches:
                for at in range(0, whole.num_rows, SLICE):
                    batch = whole.slice(at, SLICE)
                    made = [_Tree(page or "") for page in batch.column(1).to_pylist()]
                    columns = [pa.array([[dict(zip(names, n)) for n in t.nodes] for t in made], pa.list_(node))]
                    columns += [pa.array([getattr(t, c) for t in made], pa.list_(pa.string())) for c in ("strings", "scripts")]
                    yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [key, "nodes", "strings", "scripts"])
        finally:
            release()

    return pages.select(key, html).mapInArrow(run, f"{key} {pages.schema[key].dataType.simpleString()}, {PAGE}")


def _text(node: Column) -> Column:
    return squash(F.array_join(F.slice("strings", node["low"] + 1, node["high"] - node["low"]), " "))


def _where(holds: Callable[[Column, Column], Column]) -> Column:
    """The places of the elements for which a rule holds, in order."""
    return F.array_compact(F.transform("nodes", lambda x, i: F.when(holds(x, i), i)))


def _node(i: Column) -> Column:
    return F.get("nodes", i)


def _inside(low: Column, high: Column, *tags: str) -> Column:
    return _where(lambda x, i: x["tag"].isin(*tags) & (i > low) & (i <= high))


def _line(i: Column) -> Column:
    """A table row's cells with dashes between them."""
    cells = F.transform(_inside(i, _node(i)["last"], "th", "td"), lambda j: _text(_node(j)))
    return F.array_join(F.filter(cells, lambda c: c != ""), " - ")


def _says(node: Column) -> Column:
    return F.lower(strip_accents(_text(node))).contains(SAYS)


def milestone_events(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, event_order, event_year, event_date, event_text) of each page: ``pages`` has a key and its HTML.

    Script labels come first, then lists and tables beside the section's heading, paragraphs of its body, and up to 15
    elements after the heading, until the next one; a page without any of these gives its lines with a year.  Of equal
    texts, whatever their case, the first stays.
    """
    none = F.array().cast("array<string>")
    out = trees(pages, key, html)
    titled = F.get(_where(lambda x, i: F.array_contains(x["classes"], TITLE)), F.lit(0))
    out = out.withColumn("h", titled)
    out = out.withColumn("h", F.coalesce(F.when(_says(_node(F.col("h"))), F.col("h")), F.get(_where(lambda x, i: x["tag"].isin(*TITLED) & _says(x)), F.lit(0))))
    out = out.withColumn("up", _node(F.col("h"))["parent"])
    out = out.withColumn("end", F.when(F.col("up") >= 0, _node(F.col("up"))["last"]).otherwise(F.size("nodes")))
    # near the heading
    listed = F.transform(_inside(F.col("up"), F.col("end"), "li"), lambda i: _text(_node(i)))
    rows = F.transform(_inside(F.col("up"), F.col("end"), "tr"), _line)
    boxes = _where(lambda x, i: (x["tag"] == "div") & F.array_contains(x["classes"], CONTAINER) & (i < F.col("h")) & (x["last"] >= F.col("h")))
    out = out.withColumns({"listed": listed, "rows": rows, "box": F.try_element_at(boxes, F.lit(-1))})
    body = F.get(_where(lambda x, i: (x["tag"] == "div") & F.array_contains(x["classes"], BODY) & (i > F.col("box")) & (i <= _node(F.col("box"))["last"])), F.lit(0))
    out = out.withColumn("body", body)
    out = out.withColumn("told", F.transform(_inside(F.col("body"), _node(F.col("body"))["last"], "p"), lambda i: _text(_node(i))))
    # after the heading
    after = F.slice(_where(lambda x, i: (x["parent"] == F.col("up")) & (i > F.col("h"))), 1, MOST_SIBLINGS)
    out = out.withColumn("after", after)
    stop = F.array_position(F.transform("after", lambda i: _node(i)["tag"].isin(*HEADINGS)), True)
    out = out.withColumn("after", F.when(stop > 0, F.slice("after", 1, stop.cast("int") - 1)).otherwise(F.col("after")))

    def sibling(i: Column) -> Column:
        tag, last, text = _node(i)["tag"], _node(i)["last"], _text(_node(i))
        items = F.transform(_inside(i, last, "li"), lambda j: _text(_node(j)))
        lines = F.transform(_inside(i, last, "tr"), _line)
        plain = F.when(history_year(text).isNotNull() & ~text.contains("var _"), F.array(text))
        return F.when(tag.isin("script", "style"), none).when(tag.isin("ul", "ol"), items).when(tag == "table", lines).otherwise(F.coalesce(plain, none))

    labels = F.flatten(F.transform("scripts", lambda s: F.regexp_extract_all(F.regexp_extract(s, CATEGORIES, 1), F.lit('"([^"]+)"'), 1)))
    found = F.concat(labels, F.coalesce("listed", none), F.coalesce("rows", none), F.coalesce("told", none), F.coalesce(F.flatten(F.transform("after", sibling)), none))
    clean = lambda texts: F.filter(F.transform(texts, squash), lambda t: t != "")
    out = out.withColumn("found", clean(found))
    lines = F.flatten(F.transform("strings", lambda s: F.split(s, "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")))
    every = F.filter(clean(lines), lambda t: (F.length(t) >= LEAST_CHARS) & history_year(t).isNotNull())
    out = out.withColumn("found", F.when(F.size("found") > 0, F.col("found")).otherwise(every))
    out = out.withColumn("small", F.transform("found", F.lower))
    once = F.filter("found", lambda t, i: F.array_position("small", F.lower(t)) == i + 1)
    out = out.select(key, F.posexplode(once).alias("place", "event_text"))
    return out.select(key, (F.col("place") + 1).alias("event_order"), history_year(F.col("event_text")).alias("event_year"), F.nullif(F.regexp_extract("event_text", DATE, 1), F.lit("")).alias("event_date"), "event_text")
