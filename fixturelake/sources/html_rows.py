"""Rows of HTML pages: fixture, result, form and week tables, and listing cards, as one job with several layouts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixturelake.cluster import ship
from fixturelake.functions.scalars import label_key

#: A layout: the tag and class (or beginning of the id) of a row, the tag of its cells, and the class of a heading row.
LAYOUTS = {
    "fixture": {"row": ("tr", None), "cell": "td", "header": "competition"},
    "results": {"row": ("div", "#g_1_"), "cell": "div", "header": "event__header"},
    "form": {"row": ("tr", "row"), "cell": "td", "header": "competition"},
    "week": {"row": ("tr", "alt"), "cell": "td", "header": "week"},
    "listing": {"row": ("div", "product"), "cell": "div", "header": "products-title"},
    "links": {"row": ("li", None), "cell": "a", "header": "-"},
}
# Elements that end an open one of the same kind, up to the holder around it.
_IMPLIED = {"td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr"}, "li": {"li"}}
_HOLDERS = frozenset({"table", "ul", "ol"})
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Start tags that are read by their own text, and elements whose content is no markup.
_PLAIN = re.compile(r"""[a-zA-Z][a-zA-Z0-9]*(?:[ \t\n\r\f]+[a-zA-Z-]+=(?:'[^'<>]*'|"[^"<>]*"))*[ \t\n\r\f]*/?""")
_PLAIN_END = re.compile("/[a-zA-Z][a-zA-Z0-9]*")
_RAW = frozenset("script style textarea title iframe noembed noframes noscript xmp plaintext".split())
_KNOWN = 10_000
#: Pages that are taken from a batch, and rows that are given back, at a time.
_PAGES, _ROWS = 100, 2_000
_FIELDS = {
    "page_id": (pa.int64(), "long"),
    "seq": (pa.int32(), "int"),
    "kind": (pa.string(), "string"),
    "row_id": (pa.string(), "string"),
    "href": (pa.string(), "string"),
    "cells": (pa.list_(pa.string()), "array<string>"),
    "parts": (pa.list_(pa.struct([("path", pa.string()), ("text", pa.string())])), "array<struct<path:string,text:string>>"),
    "section": (pa.int64(), "long"),
    "heading": (pa.string(), "string"),
}
_COLUMNS = ["page_id", "seq", "kind", "row_id", "href", "cells", "parts"]


def _text(words: list[str]) -> str:
    return " ".join("".join(words).split())


class _Rows(HTMLParser):
    """Collects the rows of a layout; parts are all elements of a row with the classes above them.

    Pages of plain tags are split at them, and each different tag is parsed once; others go through the parser as a whole.
    """

    def __init__(self, layout: dict, parts: bool = True) -> None:
        super().__init__()
        self.layout, self.with_parts, self.known = layout, parts, {}
        self.rows, self.row, self.stack = [], None, []

    def read(self, page: str) -> list[dict]:
        """kind, id, href (first link), cells and parts of the rows of a page."""
        if not self._split(page):
            self._clear()
            self.feed(page)
            self.close()
        self.finish()
        rows = self.rows
        self._clear()
        return rows

    def _clear(self) -> None:
        self.reset()
        self.rows, self.row, self.stack = [], None, []

    def _split(self, page: str) -> bool:
        """Read a page of plain tags; whether it is one."""
        for at, piece in enumerate(page.split("<")):
            data = piece
            if at:
                head, closed, data = piece.partition(">")
                tag = self.known.get(head) or self._tag(head)
                if not closed or not tag:
                    return False
                if head[0] == "/":
                    self.handle_endtag(tag)
                else:
                    self.start(*tag)
                    if head[-1] == "/":
                        self.handle_endtag(tag[0])
            if data and self.row is not None:
                self.handle_data(unescape(data) if "&" in data else data)
        return True

    def _tag(self, head: str) -> tuple | str | None:
        """What ``start`` takes of a plain start tag, or the name of a plain end tag."""
        if _PLAIN_END.fullmatch(head):
            tag = head[1:].lower()
        elif _PLAIN.fullmatch(head):
            one = _Tag()
            one.feed(f"<{head}>")
            tag = self._start(*one.found)
        else:
            return None
        if (tag if head[0] == "/" else tag[0]) in _RAW:
            return None
        if len(self.known) >= _KNOWN:
            self.known.clear()
        self.known[head] = tag
        return tag

    def _start(self, tag: str, attrs: list) -> tuple:
        have = dict(attrs)
        classes = (have.get("class") or "").split()
        return tag, have.get("id"), have.get("href"), ".".join([tag, *classes]).replace("/", "_"), self._starts(tag, have, classes)

    def _starts(self, tag: str, have: dict, classes: list[str]) -> str | None:
        name, named = self.layout["row"]
        if self.layout["header"] in classes and tag == name:
            return "header"
        if tag != name or (named and not ((have.get("id") or "").startswith(named[1:]) if named[0] == "#" else named in classes)):
            return None
        return "row"

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.start(*self._start(tag, attrs))

    def start(self, tag: str, ident: str | None, href: str | None, label: str, kind: str | None) -> None:
        for k in range(len(self.stack) - 1, -1, -1) if tag in _IMPLIED else ():
            if self.stack[k][0] in _HOLDERS:
                break
            if self.stack[k][0] in _IMPLIED[tag]:
                del self.stack[k:]
                if not self.stack:
                    self.finish()
                break
        if self.row is None:
            if kind:
                self.row = {"kind": kind, "row_id": ident, "href": None, "cells": [[]] if kind == "header" else [], "parts": []}
                self.stack = [(tag, self.row["cells"][0] if kind == "header" else None, None, "")]
            return
        if tag == "a" and self.row["href"] is None:
            self.row["href"] = href
        if tag in _VOID:
            return
        part, above, cell = None, self.stack[-1][3], None
        path = f"{above}/{label}" if above else label
        if self.with_parts:
            part = []
            self.row["parts"].append((path, part))
        # the cells of a row nested in a cell belong to the cell
        if self.row["kind"] == "row" and tag == self.layout["cell"] and all(s[1] is None for s in self.stack):
            cell = []
            self.row["cells"].append(cell)
        self.stack.append((tag, cell, part, path))

    def handle_endtag(self, tag: str) -> None:
        if self.row is None or all(s[0] != tag for s in self.stack):
            return
        while self.stack.pop()[0] != tag:
            pass
        if not self.stack:
            self.finish()

    def finish(self) -> None:
        if self.row is not None:
            self.row["cells"] = [_text(c) for c in self.row["cells"]]
            self.row["parts"] = [(p, _text(w)) for p, w in self.row["parts"]]
            self.rows.append(self.row)
            self.row, self.stack = None, []

    def handle_data(self, data: str) -> None:
        for _, cell, part, _ in self.stack:
            if cell is not None:
                cell.append(data)
            if part is not None:
                part.append(data)


class _Tag(HTMLParser):
    """The name and attributes of one start tag."""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.found = tag, attrs


def _find(texts: dict[str, list[str]]):
    """For the parts of a row, each name's texts: those of the parts whose path fits its first pattern that finds any."""
    patterns = [re.compile(p) for ps in texts.values() for p in ps]
    places = [(name, k) for k, name in enumerate(n for n, ps in texts.items() for _ in ps)]

    @lru_cache(_KNOWN)
    def fits(path: str) -> list[int]:
        return [k for k, p in enumerate(patterns) if p.search(path)]

    def find(parts: list[tuple[str, str]]) -> dict[str, list[str]]:
        hits: list[list[str]] = [[] for _ in patterns]
        for path, text in parts:
            if text:
                for k in fits(path):
                    hits[k].append(text)
        out: dict[str, list[str]] = {name: [] for name in texts}
        for name, k in places:
            out[name] = out[name] or hits[k]
        return out

    return find


def _row_batches(layout: dict, names: list[str], texts: dict[str, list[str]]):
    """A step that takes few pages and gives back few rows at a time, so that a task's memory does not grow with its batches."""
    kinds = {n: _FIELDS[n][0] for n in names} | {n: pa.list_(pa.string()) for n in texts}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, find = _Rows(layout, bool(texts) or "parts" in names), _find(texts)
        out: dict[str, list] = {n: [] for n in kinds}

        def taken() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in kinds.items()], list(kinds))
            for c in out.values():
                c.clear()
            return batch

        for b in (b.slice(k, _PAGES) for b in batches for k in range(0, b.num_rows, _PAGES)):
            for page, html in zip(b.column("page_id").to_pylist(), b.column("html").to_pylist(), strict=True):
                section, heading = 0, None
                for seq, row in enumerate(parser.read(html or "")):
                    if row["kind"] == "header":
                        section, heading = section + 1, row["cells"][0]
                    row |= {"page_id": page, "seq": seq, "section": section, "heading": heading}
                    if texts:
                        row |= find(row["parts"])
                    for n, c in out.items():
                        c.append(row[n])
                    if len(out["page_id"]) >= _ROWS:
                        yield taken()
        yield taken()

    return run


def extract_html_rows(pages: DataFrame, layout: str, page_id: str = "page_id", col: str = "html", columns: list[str] | None = None, texts: dict[str, list[str]] | None = None) -> DataFrame:
    """page_id, seq, kind (row or header), row_id, href, cells, parts of the rows of each page (S9, S10, S13-S15), or ``columns`` of them.

    Of the columns, ``section`` is the number of headers up to a row and ``heading`` the text of the last one. For each name in ``texts``
    there is an array more, of the texts of the elements whose path fits the first of its patterns that finds any.
    """
    names, texts = columns or _COLUMNS, texts or {}
    ship(pages.sparkSession)
    schema = ", ".join([*[f"{n} {_FIELDS[n][1]}" for n in names], *[f"{n} array<string>" for n in texts]])
    return pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(col).alias("html")).mapInArrow(_row_batches(LAYOUTS[layout], names, texts), schema)


def _cell(k: int) -> Column:
    return F.get("cells", F.lit(k))


def parse_fixture_html(pages: DataFrame) -> DataFrame:
    """Fixtures of a season page with their section and competition: date, home, score, away and half time in cells 1, 3, 5, 7 and 9."""
    rows = extract_html_rows(pages, "fixture", columns=["page_id", "seq", "kind", "section", "heading", "cells"]).where("kind = 'row'")
    return rows.select("page_id", "seq", "section", F.col("heading").alias("competition"), _cell(0).alias("date"), _cell(2).alias("home"), _cell(4).alias("ft"), _cell(6).alias("away"), F.nullif(_cell(8), F.lit("")).alias("ht"))


def _club_paths(side: str) -> list[str]:
    own, other = rf"event__participant--{side}(?![^./])", f"{side[0].upper()}{side[1:]}Team"
    return [
        rf"{own}.*/.*\.participant__participantName(?![^./])", rf"{own}.*/a[^/]*$", rf"{other}.*/[^/]*participantName[^/]*$", rf"{side}Team.*/[^/]*name[^/]*$",
        rf"{own}.*/.*\.event__participantName(?![^./])", rf"{own}.*/span[^/]*$", rf"{own}[^/]*$",
    ]


def parse_results_html(pages: DataFrame) -> DataFrame:
    """Results with the id after ``g_1_``: clubs by the first place that names them, full time only if both scores are there."""
    scores = {f"{s}_score": [rf"\.event__score--{s}(?![^./])[^/]*$"] for s in ("home", "away")}
    places = {"time": [r"\.event__time(?![^./])[^/]*$"], "home": _club_paths("home"), "away": _club_paths("away"), **scores, "named": [r"participant[^/]*$"]}
    rows = extract_html_rows(pages, "results", columns=["page_id", "seq", "kind", "row_id"], texts=places).where("kind = 'row'").withColumn("match", F.substring("row_id", 5, 1_000_000)).where("match <> ''")
    found = {n: F.when(F.size(n) > 0, F.array_join(n, " ")) for n in places}
    number = {n: found[n].try_cast("int") for n in scores}
    both = number["home_score"].isNotNull() & number["away_score"].isNotNull()
    clubs = [F.coalesce(found[n], F.get(F.array_distinct("named"), F.lit(k))).alias(n) for k, n in enumerate(("home", "away"))]
    return rows.select("page_id", "seq", F.col("match").alias("id"), found["time"].alias("time"), *clubs, *[F.when(both, s).alias(n) for n, s in number.items()])


def parse_form_html(pages: DataFrame) -> DataFrame:
    """Form rows: league, date, clubs, score, whether played, and the id in the link."""
    rows = extract_html_rows(pages, "form", columns=["page_id", "seq", "kind", "href", "cells"]).where("kind = 'row'")
    return rows.select("page_id", "seq", _cell(0).alias("league"), _cell(1).alias("date"), _cell(2).alias("home"), _cell(3).alias("score"), _cell(4).alias("away"), F.coalesce(_cell(3).rlike(r".*\d+.*-.*\d+.*"), F.lit(False)).alias("completed"), F.nullif(F.regexp_extract("href", r"(\d{7})", 1), F.lit("")).alias("match_id"))


def parse_week_html(pages: DataFrame) -> DataFrame:
    """Week fixtures: finished by status, unplayed kept with ``v``, blank half time as ``?-?``."""
    rows = extract_html_rows(pages, "week", columns=["page_id", "seq", "kind", "cells"]).where("kind = 'row'")
    done = F.coalesce(_cell(1).isin("MS", "UZ", "Pen"), F.lit(False))
    return rows.select("page_id", "seq", _cell(0).alias("date"), done.alias("finished"), _cell(2).alias("home"), _cell(3).alias("score"), _cell(4).alias("away"), F.coalesce(F.nullif(_cell(5), F.lit("")), F.lit("?-?")).alias("ht")).where("finished OR score = 'v'")


def extract_listing(pages: DataFrame, labels: dict[str, str], skip: list[str]) -> DataFrame:
    """page_id, seq, fields: the label and value cells of a card as a map, without the skipped labels."""
    rows = extract_html_rows(pages, "listing", columns=["page_id", "seq", "kind", "cells"]).where("kind = 'row'")
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(F.size("cells") / 2).cast("int") - 1)), lambda i: F.struct(F.get("cells", i * 2).alias("k"), F.get("cells", i * 2 + 1).alias("v")))
    long = rows.select("page_id", "seq", F.posexplode(pairs).alias("at", "p")).where("p.k IS NOT NULL AND p.v IS NOT NULL")
    keyed = long.select("page_id", "seq", "at", label_key(F.col("p.k"), labels).alias("k"), F.col("p.v").alias("v"))
    kept = keyed.where(~F.col("k").isin(skip)) if skip else keyed
    # of a label that comes twice the last value on the card
    each = kept.groupBy("page_id", "seq", "k").agg(F.max_by("v", "at").alias("v"))
    return each.groupBy("page_id", "seq").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("fields"))
