"""Workbooks as tables of cells and of sheets.

One workbook is one row of work for a small decoder of the file format; everything after it is Spark. A
file that cannot be decoded becomes a row with an error, never a failed job.
"""

from __future__ import annotations

import datetime
import hashlib
import io
import json
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.workers import importable

_M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
# Fixed values of the file format: numbers of built-in formats that show dates, times or both.
DATE_FORMATS = frozenset({*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)})
BUILTIN = {0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 14: "mm-dd-yy", 22: "m/d/yy h:mm", 49: "@"}


def _number(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def _box(ref: str) -> tuple[int, int, int, int]:
    """First row, first column, last row and last column of A1 or A1:B2."""
    ends = [re.fullmatch(r"\$?([A-Z]+)\$?(\d+)", x) for x in (ref + ":" + ref).split(":")[:2]]
    return int(ends[0][2]), _number(ends[0][1]), int(ends[1][2]), _number(ends[1][1])


def _on(node, name: str) -> bool:
    found = node.find(_M + name) if node is not None else None
    return found is not None and found.get("val", "1") not in ("0", "false")


def _plain(node) -> str:
    """Text of a string item: its runs, without the phonetic ones."""
    return "".join(t.text or "" for part in node if part.tag in (_M + "t", _M + "r") for t in ([part] if part.tag == _M + "t" else part.findall(_M + "t")))


class Book:
    """Parts of one workbook file."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = set(self.zip.namelist())
        book = self.xml("xl/workbook.xml")
        strings = self.xml("xl/sharedStrings.xml")
        self.strings = [_plain(si) for si in strings.findall(_M + "si")] if strings is not None else []
        first = book.find(_M + "workbookPr")
        self.epoch = datetime.datetime(1904, 1, 1) if first is not None and first.get("date1904") in ("1", "true") else datetime.datetime(1899, 12, 30)
        self._read_styles()
        rels = self.relations("xl/workbook.xml")
        self.sheets = [(s, rels[s.get(_R + "id")][1]) for s in book.find(_M + "sheets") if rels[s.get(_R + "id")][0].endswith("/worksheet")]

    def xml(self, name: str):
        return ElementTree.fromstring(self.zip.read(name)) if name in self.names else None

    def relations(self, part: str) -> dict[str, tuple[str, str]]:
        """(type, target) by id; targets inside the file are whole names."""
        folder, name = posixpath.split(part)
        root = self.xml(f"{folder}/_rels/{name}.rels")
        out = {}
        for r in root if root is not None else ():
            target = r.get("Target")
            if r.get("TargetMode") != "External":
                target = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"{folder}/{target}")
            out[r.get("Id")] = (r.get("Type", ""), target)
        return out

    def _read_styles(self) -> None:
        root = self.xml("xl/styles.xml")
        part = lambda name: list(root.find(_M + name) or ()) if root is not None and root.find(_M + name) is not None else []
        bold = [_on(f, "b") for f in part("fonts")]
        fills = [self._fill(f.find(_M + "patternFill")) for f in part("fills")]
        sides = [{k for k in ("left", "right", "top", "bottom") if b.find(_M + k) is not None and b.find(_M + k).get("style")} for b in part("borders")]
        custom = {int(x.get("numFmtId")): x.get("formatCode") for x in part("numFmts")}
        pick = lambda rows, i, other: rows[i] if i < len(rows) else other
        self.styles = []
        for xf in part("cellXfs"):
            number, at = int(xf.get("numFmtId", 0)), xf.find(_M + "alignment")
            code = custom.get(number, BUILTIN.get(number, f"builtin:{number}"))
            bare = re.sub(r'"[^"]*"|\\.|_.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', "", code)
            self.styles.append(
                {
                    "bold": pick(bold, int(xf.get("fontId", 0)), False),
                    "fill": pick(fills, int(xf.get("fillId", 0)), None),
                    "sides": pick(sides, int(xf.get("borderId", 0)), set()),
                    "number_format": code,
                    "horizontal": at.get("horizontal") if at is not None else None,
                    "vertical": at.get("vertical") if at is not None else None,
                    "date": number in DATE_FORMATS or (number in custom and re.search("[dmhysDMHYS]", bare) is not None and code != "General"),
                    "span": re.search(r"\[(h+|m+|s+)\]", code) is not None,
                }
            )
        self.plain = {"bold": False, "fill": None, "sides": set(), "number_format": "General", "horizontal": None, "vertical": None, "date": False, "span": False}

    @staticmethod
    def _fill(pattern) -> str | None:
        if pattern is None or pattern.get("patternType", "none") == "none":
            return None
        color = pattern.find(_M + "fgColor")
        if color is None:
            return "00000000"
        if color.get("indexed") is not None:
            return f"indexed:{color.get('indexed')}"
        if color.get("theme") is not None:
            return f"theme:{color.get('theme')}"
        return None if color.get("auto") else color.get("rgb", "00000000")

    def value(self, cell, style: dict) -> tuple[str | None, str]:
        """(value as text, data type) of a cell: n number, s text, b true or false, e error, d date."""
        kind, v = cell.get("t", "n"), cell.find(_M + "v")
        if kind == "inlineStr":
            inner = cell.find(_M + "is")
            return (_plain(inner) if inner is not None else None), "s"
        text = v.text if v is not None else None
        if text is None:
            return None, "n"
        if kind == "s":
            return self.strings[int(text)], "s"
        if kind == "b":
            return str(text not in ("0", "false")), "b"
        if kind == "n":
            number = float(text) if re.search("[.eE]", text) else int(text)
            return (self._moment(number, style["span"]), "d") if style["date"] else (str(number), "n")
        if kind == "d":
            return str(datetime.datetime.fromisoformat(text.removesuffix("Z"))), "d"
        return text, "e" if kind == "e" else "s"

    def _moment(self, days: float, span: bool) -> str:
        whole, part = divmod(days, 1)
        rest = datetime.timedelta(milliseconds=round(part * 86_400_000))
        if span:
            return str(datetime.timedelta(days=whole) + rest)
        if 0 <= days < 1 and rest.days == 0:
            return str((datetime.datetime.min + rest).time())
        if 0 < days < 60 and self.epoch.year == 1899:
            whole += 1  # the format takes 1900 for a leap year
        return str(self.epoch + datetime.timedelta(days=whole) + rest)

    def tables(self) -> Iterator[tuple[dict, list[dict]]]:
        """(sheet, cells) of each worksheet; cells carry a value, merge, fill, bold font, border, link or comment."""
        for index, (sheet, part) in enumerate(self.sheets, start=1):
            root, rels = self.xml(part), self.relations(part)
            kind = lambda name: [t for k, t in rels.values() if k.endswith(f"/{name}")]
            comments = {c.get("ref"): _plain(c.find(_M + "text")) for name in kind("comments") for c in self.xml(name).iter(_M + "comment")}
            links = {}
            for x in root.iter(_M + "hyperlink"):
                r1, c1, r2, c2 = _box(x.get("ref"))
                links |= {(r, c): rels.get(x.get(_R + "id"), ("", None))[1] for r in range(r1, r2 + 1) for c in range(c1, c2 + 1)}
            merged = {m.get("ref"): _box(m.get("ref")) for m in root.iter(_M + "mergeCell")}
            hidden_cols = {int(x.get("min")) for x in root.iter(_M + "col") if x.get("hidden") in ("1", "true")}  # a group is hidden by its first column
            hidden_rows, cells = set(), {}
            for row in root.iter(_M + "row"):
                if row.get("hidden") in ("1", "true"):
                    hidden_rows.add(int(row.get("r")))
                for cell in row.findall(_M + "c"):
                    style = self.styles[int(cell.get("s", 0))] if int(cell.get("s", 0)) < len(self.styles) else self.plain
                    r, c, _, _ = _box(cell.get("r"))
                    cells[(r, c)] = (*self.value(cell, style), style, bool(style["sides"]), None)
            for ref, (r1, c1, r2, c2) in merged.items():
                value, data, style, border, _ = cells.get((r1, c1), (None, "n", self.plain, False, None))
                for r in range(r1, r2 + 1):
                    for c in range(c1, c2 + 1):
                        edges = {k for k, there in (("top", r == r1), ("bottom", r == r2), ("left", c == c1), ("right", c == c2)) if there}
                        cells[(r, c)] = (value, data, style, border, ref) if (r, c) == (r1, c1) else (None, "n", self.plain, bool(edges & style["sides"]), ref)
            rows = []
            for (r, c), (value, data, style, border, ref) in sorted(cells.items()):
                at = f"{_letters(c)}{r}"
                if value not in (None, "") or ref or style["fill"] or style["bold"] or border or at in comments or (r, c) in links:
                    own = {k: style[k] for k in ("bold", "fill", "number_format", "horizontal", "vertical")}
                    place = {"cell": at, "row": r, "column": c, "merged_range": ref, "is_hidden_row": r in hidden_rows, "is_hidden_col": c in hidden_cols}
                    rows.append({"value": value, "data_type": data, "border": border, "hyperlink": links.get((r, c)), "comment": comments.get(at), **own, **place})
            drawn = [self.xml(name) for name in kind("drawing")]
            count = lambda tag: sum(1 for d in drawn for x in d.iter() if x.tag.endswith(tag))
            sizes = {"images": count("}pic"), "charts": count("}chart"), "Excel tables": len(kind("table"))}
            about = {"sheet_index": index, "sheet_name": sheet.get("name"), "hidden": sheet.get("state", "visible") != "visible"}
            yield about | {"drawings": [f"{n} {k}" for k, n in sizes.items() if n]}, [{**about, **row} for row in rows]


def _letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


PARSED = "path string, digest string, kind string, body string, error string"
CELL = (
    "sheet_index int, sheet_name string, hidden boolean, value string, data_type string, border boolean, hyperlink string, comment string, bold boolean, fill string, "
    "number_format string, horizontal string, vertical string, cell string, row int, column int, merged_range string, is_hidden_row boolean, is_hidden_col boolean"
)
SHEET = "sheet_index int, sheet_name string, hidden boolean, drawings array<string>"


def parsed(files: DataFrame) -> DataFrame:
    """(path, digest, kind, body, error): a JSON row per sheet and cell of the workbooks (path, content)."""
    importable(files.sparkSession)
    names = [c.split()[0] for c in PARSED.split(", ")]

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                content = bytes(content or b"")
                head = (path, hashlib.sha1(content).hexdigest()[:12])
                try:
                    rows = [(*head, kind, json.dumps(x), None) for about, cells in Book(content).tables() for kind, x in [("sheet", about), *(("cell", c) for c in cells)]]
                except Exception as e:  # noqa: BLE001  any fault of a file is a row
                    rows = [(*head, "error", None, str(e)[:300] or type(e).__name__)]
                yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(parse, PARSED)


def _slug(value: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")
    return F.when(plain == "", F.substring(F.sha1(value.cast("binary")), 1, 10)).otherwise(plain)


def _workbook() -> Column:
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    return F.concat(F.lit("wb."), _slug(stem), F.lit("."), "digest")


def _sheet() -> Column:
    return F.concat(_workbook(), F.lit(".sheet."), F.lpad(F.col("x.sheet_index").cast("string"), 3, "0"))


def cells_table(rows: DataFrame) -> DataFrame:
    """Parsed rows as the cells collection."""
    c = rows.where("kind = 'cell'").withColumn("x", F.from_json("body", CELL))
    style = F.struct(F.col("x.fill").alias("fill_color"), F.col("x.bold").alias("font_bold"), "x.border", "x.number_format", "x.horizontal", "x.vertical")
    return c.select(
        _workbook().alias("workbook_id"),
        F.col("path").alias("file_path"),
        _sheet().alias("sheet_id"),
        "x.sheet_name",
        "x.cell",
        F.concat(F.lit("cell."), _slug(_sheet()), F.lit("."), F.lower("x.cell")).alias("evidence_id"),
        "x.value",
        "x.data_type",
        "x.row",
        "x.column",
        "x.merged_range",
        style.alias("style"),
        "x.hyperlink",
        "x.comment",
        "x.is_hidden_row",
        "x.is_hidden_col",
    )


def sheets_table(rows: DataFrame) -> DataFrame:
    """Parsed rows as the sheets collection: workbook, file, name, whether hidden, and the drawings that are not read."""
    s = rows.where("kind = 'sheet'").withColumn("x", F.from_json("body", SHEET))
    name = F.substring_index("path", "/", -1)
    return s.select(_workbook().alias("workbook_id"), name.alias("file_name"), _sheet().alias("sheet_id"), "x.sheet_name", "x.sheet_index", "x.hidden", "x.drawings")


def read_workbooks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Cells and sheets of the .xlsx files under a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    rows = parsed(files.select("path", "content").repartition("path"))
    return cells_table(rows), sheets_table(rows)
