"""One pass of the standard HTML parser over a page: a flat row for each element and each text, numbered in document order."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomscan.plans.shared import materialize

VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
#: Elements whose text is no text of the page.
SILENT = frozenset(("script", "style", "template"))
#: An opening tag ends the open tags of these names.
ENDS = {"p": ("p",), "li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",), "div": ("p",), "ul": ("p",), "h1": ("p",), "h2": ("p",)}
SCHEMA = "page_id long, node int, last int, parent int, depth int, place int, siblings int, of_type int, alike int, tag string, element_id string, classes array<string>, attrs map<string,string>, text string"
TEXT = "#text"
#: Rows of a batch on their way to Spark, at least; a batch ends with a page.
BATCH_ROWS = 1 << 12
#: Pages of a batch on their way to a parser, at most.
BATCH_PAGES = 256
_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "map<string,string>": pa.map_(pa.string(), pa.string())}


class Nodes(HTMLParser):
    """rows: dicts of the columns after page_id. last is the number of the last row inside, so that row n is inside row a if a.node < n.node <= a.last."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.open: list[int] = []
        self.names: Counter = Counter()
        self.inside: dict[int | None, Counter] = {}
        self.pieces: dict[int, list[str]] = {}

    def _add(self, tag: str, attrs: dict[str, str], text: str) -> int:
        node, parent = len(self.rows), self.open[-1] if self.open else None
        row = {"node": node, "last": node, "parent": parent, "depth": len(self.open), "place": None, "siblings": None, "of_type": None, "alike": None, "tag": tag, "element_id": attrs.get("id"), "classes": attrs.get("class", "").split(), "attrs": attrs, "text": text}
        if tag != TEXT:
            count = self.inside.setdefault(parent, Counter())
            count[tag] += 1
            count[TEXT] += 1  # all elements of the parent
            row |= {"place": count[TEXT], "of_type": count[tag]}
        self.rows.append(row)
        return node

    def _shut(self) -> str:
        """Closes the innermost open element and tells its tag."""
        tag = self.rows[self.open.pop()]["tag"]
        self.names[tag] -= 1
        return tag

    def handle_starttag(self, tag, attrs):
        ends = ENDS.get(tag, ())
        while self.open and self.rows[self.open[-1]]["tag"] in ends:
            self._shut()
        own: dict[str, str] = {}
        for k, v in attrs:
            own.setdefault(k, v or "")
        node = self._add(tag, own, "")
        if tag not in VOID:
            self.open.append(node)
            self.names[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._shut()

    def handle_endtag(self, tag):
        if self.names[tag]:
            while self._shut() != tag:
                pass

    def handle_data(self, data):
        if text := data.strip():
            if self.open:
                self.pieces.setdefault(self.open[-1], []).append(text)
            if not (self.open and self.rows[self.open[-1]]["tag"] in SILENT):
                self._add(TEXT, {}, text)

    def close(self):
        super().close()
        for node, pieces in self.pieces.items():
            self.rows[node]["text"] = " ".join(pieces)
        for row in reversed(self.rows):
            if row["parent"] is not None:
                above = self.rows[row["parent"]]
                above["last"] = max(above["last"], row["last"])
            if row["tag"] != TEXT:
                count = self.inside[row["parent"]]
                row |= {"siblings": count[TEXT], "alike": count[row["tag"]]}


def page_nodes(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row per element and per text of every page, in document order; null pages have none.

    keep: texts of a page, such as its type, that all its rows repeat after the other columns.

    node, last, parent and depth give the place in the tree; place of siblings and of_type of alike count elements of one parent, all and of one tag, from 1.
    text is an element's own text, without that of what is inside it, or the text of a #text row. Texts of scripts, styles and templates have no row.
    """
    schema = ", ".join([SCHEMA, *(f"{c} string" for c in keep)])
    columns = [x.split() for x in schema.split(", ")]

    def batch(rows: list[dict]) -> pa.RecordBatch:
        held = [pa.array([list(r[c].items()) for r in rows] if t.startswith("map") else [r[c] for r in rows], _TYPES[t]) for c, t in columns]
        return pa.RecordBatch.from_arrays(held, names=[c for c, _ in columns])

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for part in parts:
            kept = part.select(list(keep)).to_pylist() if keep else [{}] * part.num_rows
            for page, html, own in zip(part.column(0).to_pylist(), part.column(1), kept, strict=True):
                parser = Nodes()
                parser.feed(html.as_py() or "")
                parser.close()
                for r in parser.rows:
                    r |= {"page_id": page, **own}
                rows += parser.rows
                if len(rows) >= BATCH_ROWS:
                    yield batch(rows)
                    rows = []
        yield batch(rows)

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html"), *[F.col(c).cast("string").alias(c) for c in keep]).mapInArrow(work, schema)


def written_nodes(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """page_nodes, written: a query that reads them for matches and again for texts parses every page once.

    A parser gets a few pages at a time, however many its task has, so its memory doesn't grow with the table. The session's limit is put back.
    """
    conf, limit = pages.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = conf.get(limit)
    try:
        conf.set(limit, str(min(int(old), BATCH_PAGES) if int(old) > 0 else BATCH_PAGES))
        return materialize(page_nodes(pages, keep=keep), "nodes")
    finally:
        conf.set(limit, old)
