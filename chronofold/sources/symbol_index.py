"""Symbol indexes (SCIP files) as rows: occurrences, symbols, relationships and diagnostics, one document at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.sources import protowire

# Field numbers of the public index format.
_RELATION = {1: ("symbol", "string", False), 2: ("is_reference", "bool", False), 3: ("is_implementation", "bool", False), 4: ("is_type_definition", "bool", False), 5: ("is_definition", "bool", False)}
_SYMBOL = {1: ("symbol", "string", False), 4: ("relationships", _RELATION, True), 5: ("kind", "int", False), 6: ("display_name", "string", False)}
_OCCURRENCE = {1: ("range", "ints", True), 2: ("symbol", "string", False), 3: ("roles", "int", False), 7: ("enclosing", "ints", True)}
DOCUMENT = {1: ("path", "string", False), 2: ("occurrences", _OCCURRENCE, True), 3: ("symbols", _SYMBOL, True), 4: ("language", "string", False), 6: ("encoding", "int", False)}
INDEX = {1: ("metadata", {2: ("tool", {1: ("name", "string", False), 2: ("version", "string", False)}, False)}, False), 2: ("documents", DOCUMENT, True)}

DEFINITION = 1
SCHEMA = "index string, record string, path string, symbol string, detail string, start_line long, start_char long, end_line long, end_char long"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_NAME = r"(?:[A-Za-z0-9_+$-]+|`(?:[^`]|``)+`)"
_PART = r"(?:[^ ]|  )*"
GLOBAL = re.compile(rf"(?!local )[^ ]{_PART} {_PART} {_PART} {_PART} (?:{_NAME}(?:/|#|\.|:|!|\((?:{_NAME})?\)\.)|\[{_NAME}\]|\({_NAME}\))+")
LOCAL = re.compile(r"local [A-Za-z0-9_+$-]+")


def valid_symbol(symbol: str) -> bool:
    """``local <id>``, or scheme, manager, package, version and descriptors, parted by single spaces (doubled inside a part)."""
    return bool(LOCAL.fullmatch(symbol) or GLOBAL.fullmatch(symbol))


def valid_path(path: str) -> bool:
    parts = path.split("/")
    return bool(path) and not path.startswith("/") and "\\" not in path and "\0" not in path and not any(p in ("", ".", "..", ".git") for p in parts)


def span(numbers: list[int]) -> tuple[int, int, int, int] | None:
    """(start line, start, end line, end) of three or four numbers; None where negative, reversed or of another length."""
    if len(numbers) == 3:
        numbers = [numbers[0], numbers[1], numbers[0], numbers[2]]
    if len(numbers) != 4 or min(numbers) < 0 or tuple(numbers[2:]) < tuple(numbers[:2]):
        return None
    return tuple(numbers)


def _document(doc: dict) -> Iterator[tuple]:
    path, none = doc.get("path", ""), (None,) * 4
    if not valid_path(path):
        yield "diagnostic", path, None, "unsafe_path", *none
        return
    for item in doc.get("symbols", ()):
        symbol = item.get("symbol", "")
        if not valid_symbol(symbol):
            yield "diagnostic", path, symbol, "invalid_symbol", *none
            continue
        yield "symbol", path, symbol, str(item.get("kind", 0)), *none
        for rel in item.get("relationships", ()):
            kinds = [k for k in ("is_reference", "is_implementation", "is_type_definition", "is_definition") if rel.get(k)]
            other = rel.get("symbol", "")
            yield ("relation", path, symbol, f"{','.join(kinds)} {other}", *none) if valid_symbol(other) and kinds else ("diagnostic", path, other, "invalid_relation", *none)
    for item in doc.get("occurrences", ()):
        symbol, at, outer = item.get("symbol", ""), span(item.get("range", [])), item.get("enclosing")
        around = span(outer) if outer else None
        if at is None or (outer and (around is None or around[:2] > at[:2] or around[2:] < at[2:])):
            yield "diagnostic", path, symbol, "invalid_range", *none
        elif symbol and not valid_symbol(symbol):
            yield "diagnostic", path, symbol, "invalid_symbol", *at
        elif symbol:
            yield ("definition" if item.get("roles", 0) & DEFINITION else "reference"), path, symbol, None, *at


def read_index(indexes: DataFrame, name_col: str = "path", body_col: str = "content", limits: dict | None = None) -> DataFrame:
    """Rows of each index file; a bad file is one diagnostic, too_large or malformed, and a null one is malformed."""
    limits = limits or {"fields": 20_000_000, "objects": 5_000_000}

    def rows(body: bytes | None) -> Iterator[tuple]:
        none = (None,) * 4
        try:
            if body is None:
                raise protowire.Malformed("null")
            index = protowire.read(body, INDEX, protowire.Budget(**limits))
        except protowire.TooLarge:
            yield "diagnostic", None, None, "too_large", *none
            return
        except protowire.Malformed:
            yield "diagnostic", None, None, "malformed", *none
            return
        for doc in index.get("documents", ()):
            yield from _document(doc)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 5 + [pa.int64()] * 4
        pack = lambda part: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), kinds, strict=True)], names=NAMES)
        held: list[tuple] = []
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for row in rows(body.as_py()):
                    held.append((name, *row))
                    if len(held) >= 10_000:
                        yield pack(held)
                        held = []
        if held:
            yield pack(held)

    return indexes.select(F.col(name_col).cast("string"), F.col(body_col).cast("binary")).mapInArrow(run, SCHEMA)
