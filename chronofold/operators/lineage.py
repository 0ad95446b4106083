"""File identities along a first-parent history: the one fold here whose state is a repository's set of paths.

diffs   repository, seq (of the commit on its history), commit, status (A, M, D), path, blob
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from chronofold.sources.scratch import parts

SCHEMA = "repository string, seq long, path string, file_id string, basis string, old_id string, confidence double"


class Lineage:
    """Live paths with their file and blob, and the last file of each deleted path."""

    def __init__(self, repository: str):
        self.repository, self.live, self.dead = repository, {}, {}

    def commit(self, commit: str, changes: list[tuple[str, str, str | None]]) -> Iterator[tuple]:
        """(path, file_id, basis, old_id, confidence) of every changed path, in order of the paths.

        A blob that one removed and one added path share moves the file.  Any other added path is a new file, with a claim to a removed file of its blob
        (0.5, the first by path) or else to the last file that had its path (0.25).
        """
        gone: dict[str, list[tuple[str, str]]] = {}
        came: dict[str, list[str]] = {}
        for status, path, blob in sorted(changes, key=lambda c: c[1]):
            if status == "D" and path in self.live:
                file_id, old = self.live.pop(path)
                gone.setdefault(old, []).append((path, file_id))
                self.dead[path] = file_id
                yield path, file_id, "deleted", None, None
            elif status == "A" or (status == "M" and path not in self.live):
                came.setdefault(blob, []).append(path)
            elif status == "M":
                self.live[path] = (self.live[path][0], blob)
                yield path, self.live[path][0], "modified", None, None
        for blob, paths in came.items():
            old = gone.get(blob, [])
            for path in paths:
                if len(paths) == len(old) == 1 and old[0][0] != path:
                    self.live[path] = (old[0][1], blob)
                    self.dead.pop(old[0][0], None)
                    yield path, old[0][1], "moved", old[0][1], 1.0
                    continue
                file_id = hashlib.sha256("\0".join((self.repository, path, commit)).encode()).hexdigest()[:32]
                if old:
                    claim = ("ambiguous", old[0][1], 0.5)
                elif path in self.dead:
                    claim = ("path_reused", self.dead[path], 0.25)
                else:
                    claim = ("introduced", None, None)
                self.live[path] = (file_id, blob)
                yield path, file_id, *claim


def walk(diffs: DataFrame) -> DataFrame:
    """One row for each changed path of each commit.  Histories are sorted, not gathered: a task holds one commit's changes and one repository's paths."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, at, held = None, None, []

        def close() -> list[tuple]:
            repository, seq, commit = at
            return [(repository, seq, *row) for row in state.commit(commit, held)]

        def batch_of(rows):
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["repository", "seq", "path", "file_id", "basis", "old_id", "confidence"])

        for batch in batches:
            out = []
            for repository, seq, commit, status, path, blob in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if at != (repository, seq, commit):
                    if held:
                        out += close()
                    if state is None or state.repository != repository:
                        state = Lineage(repository)
                    at, held = (repository, seq, commit), []
                held.append((status, path, blob))
            if out:
                yield batch_of(out)
        if held and (last := close()):  # a commit that only deletes unknown paths says nothing
            yield batch_of(last)

    rows = diffs.select("repository", "seq", "commit", "status", "path", "blob").repartition(parts(diffs), "repository").sortWithinPartitions("repository", "seq", "path")
    return rows.mapInArrow(fold, SCHEMA)
