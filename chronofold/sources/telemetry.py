"""Trace telemetry (OTLP requests, optionally gzip) as ledger drafts: bounded inflation and scan, records, mapping with reasons."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.sources import protowire

# Field numbers of the public trace format.
_ANY = {1: ("string", "string", False), 2: ("bool", "bool", False), 3: ("int", "int", False), 4: ("double", "double", False), 5: ("array", "bytes", False), 6: ("pairs", "bytes", False), 7: ("bytes", "bytes", False)}
_PAIR = {1: ("key", "string", False), 2: ("value", _ANY, False)}
_EVENT = {1: ("time", "fixed64", False), 2: ("name", "string", False), 3: ("attributes", _PAIR, True)}
_SPAN = {
    1: ("trace_id", "bytes", False), 2: ("span_id", "bytes", False), 5: ("name", "string", False), 7: ("start", "fixed64", False), 8: ("end", "fixed64", False),
    9: ("attributes", _PAIR, True), 11: ("events", _EVENT, True),
}
REQUEST = {1: ("resources", {1: ("resource", {1: ("attributes", _PAIR, True)}, False), 2: ("scopes", {2: ("spans", _SPAN, True)}, True)}, True)}

MAX_BODY, MAX_INFLATED, MAX_VALUE, SKEW = 4 << 20, 16 << 20, 1 << 20, 300
SCHEMA = "source string, record long, trace_id string, span_id string, event_name string, session_id string, model string, occurred_at timestamp, observed_at timestamp, outcome string"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def inflate(body: bytes) -> bytes:
    """The body, unpacked if it is gzip; ``TooLarge`` beyond the limits, ``Malformed`` for a broken or trailing stream."""
    if len(body) > MAX_BODY:
        raise protowire.TooLarge("body")
    if body[:2] != b"\x1f\x8b":
        return body
    unpack = zlib.decompressobj(31)
    try:
        out = unpack.decompress(body, MAX_INFLATED + 1)
    except zlib.error:
        raise protowire.Malformed("gzip") from None
    if len(out) > MAX_INFLATED:
        raise protowire.TooLarge("inflated body")
    if not unpack.eof or unpack.unused_data:
        raise protowire.Malformed("gzip")
    return out


def _plain(pairs: list[dict]) -> dict:
    """Attribute values; what is not a scalar is a tuple that no rule accepts."""
    out = {}
    for pair in pairs:
        value = pair.get("value", {})
        name = next(reversed(value), None)
        out[pair.get("key", "")] = value[name] if name in ("string", "bool", "int", "double") else None if name is None else (name,)
    return out


def records(request: dict) -> Iterator[tuple]:
    """(trace, span, resource attributes, attributes, nanoseconds): a span that names an event, and each of its events that does."""
    for group in request.get("resources", ()):
        shared = _plain(group.get("resource", {}).get("attributes", ()))
        for scope in group.get("scopes", ()):
            for span in scope.get("spans", ()):
                ids = span.get("trace_id", b"").hex() or None, span.get("span_id", b"").hex() or None
                own = _plain(span.get("attributes", ()))
                if "event.name" in own:
                    yield *ids, shared, own, span.get("end", 0) or span.get("start", 0)
                for event in span.get("events", ()):
                    inner = _plain(event.get("attributes", ()))
                    if "event.name" in inner:
                        yield *ids, shared, inner, event.get("time", 0)


def _time(nanos: int) -> datetime | None:
    try:
        return datetime.fromtimestamp(nanos // 1000 / 1e6, tz=UTC) if nanos > 0 else None
    except (OverflowError, OSError, ValueError):
        return None


def _draft(shared: dict, own: dict, nanos: int, rules: dict, latest: datetime) -> tuple:
    """(event name, session, model, occurred, observed, outcome); the outcome is accepted, unmapped or the first broken rule."""
    name = own.get("event.name")
    none = (name if isinstance(name, str) else None, None, None, None, None)
    if rules["marker"] in shared or rules["marker"] in own:
        return *none, "platform_origin"
    if shared.get("service.name") not in rules["services"]:
        return *none, "unknown_service"
    if len(own) > 128 or len(shared) > 64:
        return *none, "too_many_attributes"
    if any(isinstance(v, str) and len(v) > MAX_VALUE for v in own.values()):
        return *none, "attribute_value_too_long"
    if any(isinstance(v, tuple) for v in own.values()) or not isinstance(name, str):
        return *none, "invalid_attribute"
    seen = _time(nanos)
    if seen is None:
        return *none, "missing_timestamp"
    if seen > latest:
        return *none, "future_timestamp"
    if name != rules["session_event"]:
        return *none, "unmapped"
    session, stamp = own.get("conversation.id"), own.get("event.timestamp")
    if session is None or stamp is None:
        return *none, "missing_attribute"
    try:
        began = datetime.fromisoformat(stamp)
    except (TypeError, ValueError):
        return *none, "invalid_attribute"
    if not isinstance(session, str) or not 0 < len(session) <= 256 or began.tzinfo is None:
        return *none, "invalid_attribute"
    if began > latest:
        return *none, "future_timestamp"
    model = own.get("model")
    return name, session, model if isinstance(model, str) else None, began, max(began, seen), "accepted"


def drafts(bodies: DataFrame, services: list[str], session_event: str, marker: str, now: datetime, name_col: str = "path", body_col: str = "content") -> DataFrame:
    """One row per record of each request body (such as binaryFile rows), or one with outcome too_large or malformed for a bad body.

    A null body is malformed; a body without records gives no rows.  Retries give equal rows, since all times come from the data.
    """
    rules = {"services": set(services), "session_event": session_event, "marker": marker}
    latest = datetime.fromtimestamp(now.timestamp() + SKEW, tz=UTC)

    def one(source: str, body: bytes | None) -> list[tuple]:
        try:
            if body is None:
                raise protowire.Malformed("null")
            request = protowire.read(inflate(body), REQUEST)
        except protowire.TooLarge:
            return [(source, 0, *[None] * 7, "too_large")]
        except protowire.Malformed:
            return [(source, 0, *[None] * 7, "malformed")]
        return [(source, i, t, s, *_draft(a, b, n, rules, latest)) for i, (t, s, a, b, n) in enumerate(records(request))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), *[pa.string()] * 5, *[pa.timestamp("us", "UTC")] * 2, pa.string()]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=NAMES)
        held: list[tuple] = []
        for batch in batches:
            for source, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held += one(source, body.as_py())
                if len(held) >= 2000:  # small bodies share a batch, a large one is at most one body more
                    yield pack(held)
                    held = []
        if held:
            yield pack(held)

    return bodies.select(F.col(name_col).cast("string"), F.col(body_col).cast("binary")).mapInArrow(run, SCHEMA)
