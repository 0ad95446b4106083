"""Structure of Python source as a table function: symbols, references and diagnostics, by the standard parser."""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.sources.scratch import parts

#: Bytes of source files behind one parsing task.
SOURCE_BYTES = 1 << 18
SCHEMA = "path string, record string, kind string, name string, start_line long, end_line long, fingerprint string"


def python_structure(source: str) -> list[tuple]:
    """(record, kind, name, start, end, fingerprint): symbols, imports, calls, bases; a syntax error is one diagnostic."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError) as error:
        return [("diagnostic", type(error).__name__, "", getattr(error, "lineno", None) or 0, 0, "")]
    out: list[tuple] = []

    def fingerprint(node: ast.AST) -> str:
        return hashlib.sha256(ast.dump(node).encode()).hexdigest()[:16]

    def walk(node: ast.AST, scope: tuple[str, ...], in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            at = getattr(child, "lineno", 0), getattr(child, "end_lineno", 0) or 0
            if isinstance(child, ast.ClassDef):
                out.append(("symbol", "class", ".".join((*scope, child.name)), *at, fingerprint(child)))
                out.extend(("reference", "inherits", ast.unparse(b), *at, "") for b in child.bases)
                walk(child, (*scope, child.name), True)
            elif isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                out.append(("symbol", "method" if in_class else "function", ".".join((*scope, child.name)), *at, fingerprint(child)))
                walk(child, (*scope, child.name), False)
            elif isinstance(child, ast.Import | ast.ImportFrom):
                base = "." * getattr(child, "level", 0) + (getattr(child, "module", None) or "")
                out.extend(("reference", "imports", f"{base}.{a.name}" if base and isinstance(child, ast.ImportFrom) else a.name, *at, "") for a in child.names)
            elif isinstance(child, ast.Assign | ast.AnnAssign):
                targets = child.targets if isinstance(child, ast.Assign) else [child.target]
                for t in targets:
                    if isinstance(t, ast.Name):
                        kind = "constant" if t.id.isupper() else "property" if in_class else "variable"
                        out.append(("symbol", kind, ".".join((*scope, t.id)), *at, fingerprint(child)))
                walk(child, scope, False)
            else:
                if isinstance(child, ast.Call):
                    head = child.func
                    while isinstance(head, ast.Attribute):
                        head = head.value
                    if isinstance(head, ast.Name):
                        out.append(("reference", "calls", ast.unparse(child.func), *at, ""))
                walk(child, scope, in_class)

    walk(tree, (), False)
    return out


def structure(files: DataFrame, path_col: str = "path", source_col: str = "source") -> DataFrame:
    """One row per symbol, reference or diagnostic of each file; a null source has none.

    Files are dealt evenly over tasks: parsing costs far more than reading, so the splits of the input say nothing of the work.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, *r) for p, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if s is not None for r in python_structure(s)]
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.string()] * 4 + [pa.int64()] * 2 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["path", "record", "kind", "name", "start_line", "end_line", "fingerprint"])

    n = parts(files, each=SOURCE_BYTES)
    return files.select(F.col(path_col).cast("string"), F.col(source_col).cast("string")).repartition(n).mapInArrow(run, SCHEMA)
