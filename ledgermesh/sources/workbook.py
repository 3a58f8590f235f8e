"""Workbooks (xlsx, xlsm) as tables: one file is opened once, by one task, many files by many.

The scan of a file emits facts of several kinds: cells, what the book says of
itself (parts, links to other books, date system, iteration), defined names and
faults.  What needs more than one fact is a Spark step behind it: the members of
a shared formula meet its master in a window, names are joined to formulas.

A file that cannot be read gives one row with its error and detail; it never
stops the job.  Where only a later sheet is broken the cells before it are there
too: ``whole_books`` leaves out all cells of a book with an error.  Formulas are not evaluated: the cached value is a string.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from typing import NamedTuple
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.a1 import shift_formula, uses_semicolon
from ..operators.staging import stage

CELLS = "book string, sheet string, row int, col int, addr string, formula_raw string, cached_value string, hidden boolean, number_format string, comment string, error string, detail string"
#: A fact; kind: cell, book, name (name and formula_raw) or error.  shared: the number of a shared formula.
FACTS = "kind string, " + CELLS + ", shared string, name string, paths array<string>, externals array<string>, date1904 boolean, iterates boolean"
_FACT = [c.split()[0] for c in FACTS.split(", ")]

# The limits of an archive, and the number formats that files name by id alone.
MOST_PART, MOST_TOTAL, MOST_RATIO, RATIO_FROM = 512 << 20, 2 << 30, 50, 4096
FORMATS = {
    1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM",
    20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 37: "#,##0 ;(#,##0)", 38: "#,##0 ;[Red](#,##0)", 39: "#,##0.00;(#,##0.00)", 40: "#,##0.00;[Red](#,##0.00)", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 49: "@",
}

class Unreadable(Exception):
    """error and detail of a file that gives no cells."""


def _number(letters: str) -> int:
    n = 0
    for c in letters.upper():
        n = 26 * n + ord(c) - 64
    return n


def opened(content: bytes) -> zipfile.ZipFile:
    """The archive, if it keeps to the limits."""
    if not content:
        raise Unreadable("empty_file", None)
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile:
        raise Unreadable("zip_rejected", "not a zip") from None
    paths = [i.filename.replace("\\", "/") for i in z.infolist()]
    if any(posixpath.basename(p) in ("EncryptedPackage", "EncryptionInfo") for p in paths):
        raise Unreadable("encrypted_workbook", None)
    total = 0
    for path, i in zip(paths, z.infolist()):
        total += i.file_size
        faults = {"absolute path": path.startswith("/"), "zip-slip": ".." in path.split("/"), "part too large": i.file_size > MOST_PART, "archive too large": total > MOST_TOTAL, "compression ratio": i.file_size >= max(RATIO_FROM, MOST_RATIO * i.compress_size)}
        for fault, holds in faults.items():
            if holds:
                raise Unreadable("zip_rejected", fault)
    return z


def _bare(e: ElementTree.Element) -> None:
    """Drop the namespaces of an element."""
    e.tag = e.tag.rpartition("}")[2]
    for k in [k for k in e.attrib if k.startswith("{")]:
        e.attrib[k.rpartition("}")[2] if k.endswith("}id") else k] = e.attrib.pop(k)


class _Book:
    def __init__(self, z: zipfile.ZipFile):
        self.z, self.names = z, set(z.namelist())

    def raw(self, name: str) -> bytes:
        raw = self.z.read(name)
        if b"<!DOCTYPE" in raw or b"<!ENTITY" in raw:
            raise Unreadable("xml_rejected", name)
        return raw

    def part(self, name: str) -> ElementTree.Element:
        """The elements of a part without their namespaces; an absent part is empty."""
        if name not in self.names:
            return ElementTree.Element("none")
        root = ElementTree.fromstring(self.raw(name))
        for e in root.iter():
            _bare(e)
        return root

    def elements(self, name: str, *tags: str) -> Iterator[ElementTree.Element]:
        """The elements with these tags in their order, each let go when the next comes: a sheet is never a tree as a whole."""
        above = None
        for event, e in ElementTree.iterparse(io.BytesIO(self.raw(name)), ("start", "end")):
            if event == "start":
                above = e if e.tag.rpartition("}")[2] in ("sheetData", "cols") else above
            elif e.tag.rpartition("}")[2] in tags:
                for inner in e.iter():
                    _bare(inner)
                yield e
                if above is not None:
                    above.clear()

    def targets(self, name: str) -> dict[str, tuple[str, str]]:
        """Relation id -> (kind, part) of a part; what leaves the archive is left out."""
        folder, file = posixpath.split(name)
        out = {}
        for r in self.part(f"{folder}/_rels/{file}.rels".lstrip("/")).iter("Relationship"):
            to = r.get("Target", "")
            path = posixpath.normpath(to.lstrip("/") if to.startswith("/") else posixpath.join(folder, to))
            if r.get("TargetMode") != "External" and ".." not in to.split("/")[1:] and not path.startswith(".."):
                out[r.get("Id")] = (r.get("Type", "").rpartition("/")[2], path)
        return out


def _text(e: ElementTree.Element | None) -> str | None:
    return None if e is None else "".join(t.text or "" for t in e.iter("t"))


def _sheet(book: _Book, name: str, part: str, hidden: bool, strings: list[str], formats: list[str | None]) -> Iterator[tuple]:
    away: set[int] = set()
    notes = {c.get("ref"): _text(c) for kind, path in book.targets(part).values() if kind == "comments" for c in book.part(path).iter("comment")}
    # the columns stand before the rows
    for line in book.elements(part, "col", "row"):
        if line.tag == "col":
            if line.get("hidden") in ("1", "true"):
                away.update(range(int(line.get("min")), int(line.get("max")) + 1))
            continue
        for c in line.iter("c"):
            at = re.fullmatch(r"([A-Za-z]{1,3})(\d+)", c.get("r", ""))
            if not at:
                continue
            col, row, f, v = _number(at[1]), int(at[2]), c.find("f"), c.find("v")
            formula = (f.text or None) if f is not None else None
            shared = f.get("si") if f is not None and f.get("t") == "shared" else None
            value = _text(c.find("is")) if c.get("t") == "inlineStr" else v.text if v is not None else None
            if c.get("t") == "s" and value and value.strip().isdigit() and int(value) < len(strings):
                value = strings[int(value)]
            if formula is None and value is None and shared is None and at[0] not in notes:
                continue
            style = int(c.get("s", -1))
            yield name, row, col, at[0], formula, value, hidden or line.get("hidden") in ("1", "true") or col in away, formats[style] if 0 <= style < len(formats) else None, notes.get(at[0]), shared


_CELL = ("sheet", "row", "col", "addr", "formula_raw", "cached_value", "hidden", "number_format", "comment", "shared")


def _externals(book: _Book, parts: dict[str, tuple[str, str]]) -> list[str]:
    """Targets of the links to other books; the link parts themselves where none tells one."""
    links = [path for kind, path in parts.values() if kind == "externalLink"]
    found = []
    for path in links:
        folder, file = posixpath.split(path)
        found += [r.get("Target") for r in book.part(f"{folder}/_rels/{file}.rels").iter("Relationship") if r.get("TargetMode") == "External"]
    return found or links


def facts_of(content: bytes) -> Iterator[dict]:
    """The facts of a workbook: what the book says of itself, its names, and each cell that holds something."""
    z = opened(content)
    book = _Book(z)
    root = next((p for kind, p in book.targets("").values() if kind == "officeDocument"), "xl/workbook.xml")
    parts = book.targets(root)
    find = lambda kind: book.part(next((p for k, p in parts.values() if k == kind), ""))
    whole = book.part(root)
    yes = lambda e, *names: e is not None and any(e.get(n) in ("1", "true") for n in names)
    yield {"kind": "book", "paths": z.namelist(), "externals": _externals(book, parts), "date1904": yes(whole.find("workbookPr"), "date1904"), "iterates": yes(whole.find("calcPr"), "iterate", "iterateEnabled")}
    for n in whole.iter("definedName"):
        if n.get("name"):
            yield {"kind": "name", "name": n.get("name"), "formula_raw": (n.text or "").strip(), "hidden": yes(n, "hidden")}
    strings = [_text(e) or "" for e in find("sharedStrings").iter("si")]
    styles = find("styles")
    own = FORMATS | {int(e.get("numFmtId")): e.get("formatCode") for e in styles.iter("numFmt")}
    used = styles.find("cellXfs")
    formats = [own.get(int(x.get("numFmtId", 0))) for x in used] if used is not None else []
    for s in whole.iter("sheet"):
        kind, part = parts.get(s.get("id"), ("", ""))
        if part in book.names:
            for cell in _sheet(book, s.get("name"), part, s.get("state", "visible") != "visible", strings, formats):
                yield {"kind": "cell", **dict(zip(_CELL, cell))}


def scan(files: DataFrame, rows_at_once: int = 20_000) -> DataFrame:
    """FACTS of files (path, content)."""

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                held: list[dict] = []
                try:
                    for fact in facts_of(bytes(content)):
                        held.append({"book": name, **fact})
                        if len(held) == rows_at_once:
                            yield pd.DataFrame(held, columns=_FACT).astype(object)
                            held = []
                except Unreadable as e:
                    held.append({"kind": "error", "book": name, "error": e.args[0], "detail": e.args[1]})
                except (ElementTree.ParseError, zipfile.BadZipFile, ValueError, RuntimeError) as e:
                    held.append({"kind": "error", "book": name, "error": "parse_failed", "detail": str(e)})
                if held:
                    out = pd.DataFrame(held, columns=_FACT).astype(object)
                    yield out.where(out.notna(), None)

    return files.select("path", "content").mapInPandas(make, FACTS)


def unshared(cells: DataFrame) -> DataFrame:
    """Cells with the formulas of shared ones: a member has that of the last master before it, moved to its place."""
    some = cells.where("shared is not null")
    along = Window.partitionBy("book", "sheet", "shared").orderBy("row", "col").rowsBetween(Window.unboundedPreceding, 0)
    master = F.last(F.when(F.col("formula_raw").isNotNull(), F.struct("formula_raw", "row", "col")), True).over(along)
    some = some.withColumn("_m", master)
    formula = F.coalesce("formula_raw", shift_formula(F.col("_m.formula_raw"), F.col("col") - F.col("_m.col"), F.col("row") - F.col("_m.row")))
    some = some.withColumn("formula_raw", formula).drop("_m")
    return cells.where("shared is null").unionByName(some).where("formula_raw is not null or cached_value is not null or comment is not null")


class Books(NamedTuple):
    """cells: CELLS without faults.  books: book, paths, externals, date1904, iterates.  names: book, name, formula_raw, hidden.  errors: book, error, detail."""

    cells: DataFrame
    books: DataFrame
    names: DataFrame
    errors: DataFrame


def tables(facts: DataFrame) -> Books:
    """The tables of staged facts."""
    of = lambda kind, *cols: facts.where(F.col("kind") == kind).select(*cols)
    names = [c.split()[0] for c in CELLS.split(", ")[:-2]]
    return Books(
        unshared(of("cell", *names, "shared")).select(*names), of("book", "book", "paths", "externals", "date1904", "iterates"),
        of("name", "book", "name", "formula_raw", "hidden"), of("error", "book", "error", "detail"),
    )


def files_below(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of all files below path (a folder, file or pattern of any store that Spark reads).

    Spark's file sources leave out files of no bytes, so those are taken from a list of the store.
    """
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    bare = []
    for top in store.globStatus(where) or []:
        found = store.listFiles(top.getPath(), True)
        while found.hasNext():
            f = found.next()
            if f.getLen() == 0:
                bare.append((f.getPath().toString(), b""))
    return read.unionByName(spark.createDataFrame(bare, "path string, content binary")) if bare else read


def read_books(spark: SparkSession, path: str) -> Books:
    """All tables of all workbooks below path, each file opened once."""
    return tables(stage(scan(files_below(spark, path))))


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Cells of all workbooks below path, and a row with error and detail for each that has a fault."""
    b = read_books(spark, path)
    return b.cells.unionByName(b.errors, allowMissingColumns=True)


def whole_books(cells: DataFrame) -> DataFrame:
    """Cells of the books that have no error."""
    return cells.join(cells.where("error is not null").select("book").distinct(), "book", "left_anti")


def book_flags(cells: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """One row a book: first_ref (in the order of row and column), locale (ru where a formula has a semicolon outside of text).

    files, where given, has book and paths (the parts of the archive) and adds
    has_vba and has_xlm.
    """
    c = cells.where("error is null") if "error" in cells.columns else cells
    first = F.min(F.when(F.col("addr").isNotNull(), F.struct("sheet", "row", "col", "addr")))
    out = c.groupBy("book").agg(F.concat(first["sheet"], F.lit("!"), first["addr"]).alias("first_ref"), F.when(F.bool_or(uses_semicolon(F.col("formula_raw"))), "ru").otherwise("en").alias("locale"))
    if files is None:
        return out
    has = lambda pattern: F.exists("paths", lambda p: F.lower(p).rlike(pattern))
    return out.join(files.select("book", has(r"(^|/)vbaproject\.bin$").alias("has_vba"), has("macrosheet").alias("has_xlm")), "book", "left")


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """book and the paths of its parts, for files that are archives."""
    return read_books(spark, path).books.select("book", "paths")
