"""Identities and closed text rules as column expressions: name-based ids, node ids, order keys, offsets, remotes, keyed digests."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that need no percent encoding, and the shape of an identifier.
UNRESERVED = "[A-Za-z0-9._~-]"
IDENTIFIER = r"^[\p{L}\p{Nl}_][\p{L}\p{Nl}\p{Mn}\p{Mc}\p{Nd}\p{Pc}]*$"
SAFE_LABEL = "^[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?$"


def framed(*parts: Column | str) -> Column:
    """``<utf8 bytes>:<text>`` of each part, one after the other: no two tuples share it.  A null part makes it null."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.concat(*[x for p in cols for x in (F.octet_length(p).cast("string"), F.lit(":"), p)])


def uuid5_in(namespace: Column, name: Column) -> Column:
    """Name-based UUID, version 5, in a namespace that is a UUID column."""
    h = F.sha1(F.concat(F.unhex(F.replace(namespace, F.lit("-"), F.lit(""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(63).bitwiseOR(128)))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 19, 2), F.lit("-"), F.substring(h, 21, 12))


class Ids:
    """Identities below one root namespace, repository by repository."""

    def __init__(self, root: str):
        self.root = root

    def repository(self, repository: Column) -> Column:
        return uuid5_in(F.lit(self.root), framed("repository", repository))

    def of(self, repository: Column, *parts: Column | str) -> Column:
        return uuid5_in(self.repository(repository), framed(*parts))

    def file(self, repository: Column, path: Column, commit: Column) -> Column:
        """A file by the path and commit that brought it in, so a later move keeps it."""
        return self.of(repository, "file", path, commit)

    def uncommitted(self, repository: Column, path: Column) -> Column:
        """A file no commit has: by path, the same in every checkout."""
        return uuid5_in(self.of(repository, "namespace", "uncommitted"), framed(path))

    def provisional(self, repository: Column, checkout: Column, path: Column) -> Column:
        return uuid5_in(self.of(repository, "namespace", "provisional"), framed(checkout, path))

    def revision(self, repository: Column, file: Column, blob: Column, language: Column, parser: Column) -> Column:
        return self.of(repository, "file_revision", file, blob, language, parser)

    def symbol(self, repository: Column, scip: Column, language: Column, file: Column, name: Column, kind: Column, ordinal: Column) -> Column:
        """By its index symbol, unless that is missing or local to a document; else by language, file, name, kind and ordinal."""
        known = scip.isNotNull() & (scip != "") & ~scip.startswith("local ")
        return F.when(known, self.of(repository, "symbol_scip", scip)).otherwise(self.of(repository, "symbol_fallback", language, file, name, kind, ordinal))

    def symbol_revision(self, repository: Column, symbol: Column, signature: Column, meaning: Column) -> Column:
        return self.of(repository, "symbol_revision", symbol, signature, meaning)


def assertion_id(kind: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"as-{kind}-"), F.substring(F.sha2(framed(kind, *parts), 256), 1, 48))


def keyed_event_id(domain: str, key: Column) -> Column:
    """A UUID in the shape of version 7 that is a function of its key."""
    h = F.sha2(F.concat(F.lit(domain), key), 256)
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(63).bitwiseOR(128)))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-7"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 19, 2), F.lit("-"), F.substring(h, 21, 12))


def fixed_time(time: Column) -> Column:
    """Fixed-width text to the microsecond, which sorts as the time does."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def order_key(time: Column, ident: Column) -> Column:
    return F.concat(fixed_time(time), F.lit("|"), ident)


def resource_uri(scheme: str, event: Column, content: Column) -> Column:
    """``<scheme>events/<id>`` and, for one of its contents, ``/contents/<digest of the content id>``."""
    base = F.concat(F.lit(f"{scheme}events/"), event)
    return F.when(content.isNull(), base).otherwise(F.concat(base, F.lit("/contents/"), F.sha2(content, 256)))


def lock_number(digest: Column) -> Column:
    """The first four bytes of a digest as a signed number."""
    n = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.when(n >= 1 << 31, n - (1 << 32)).otherwise(n)


def digest_of_key(key: Column) -> Column:
    """The digest that an object key names; null for any other text, or one whose folders do not agree with it."""
    d = F.regexp_extract(key, "^sha256/[0-9a-f]{2}/[0-9a-f]{2}/([0-9a-f]{64})[.]zst$", 1)
    same = (F.substring(key, 8, 2) == F.substring(d, 1, 2)) & (F.substring(key, 11, 2) == F.substring(d, 3, 2))
    return F.when((d != "") & same, d)


def keyed_digest(key: bytes, text: Column) -> Column:
    """HMAC with SHA-256, of built-in functions: the two pads are made once from the key."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ p for b in block)) for p in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(text, "UTF-8")), 256))), 256)


def idempotency_key(key: bytes, source: str, name: Column, native: Column, time: Column, declared: Column) -> Column:
    """Source, event name, native id, time and a keyed digest of the declared attributes (canonical text), which the key does not give away."""
    return F.concat_ws(":", F.lit(source), name, native, time, keyed_digest(key, declared))


def opaque(domain: str, field: Column, value: Column) -> Column:
    return F.sha2(F.concat(F.lit(domain), field, value), 256)


def byte_offset(line: Column, character: Column, encoding: Column) -> Column:
    """Byte offset in ``line`` of a column counted in utf-8, utf-16 or utf-32 units; null past the line, inside a character, or where the encoding is unknown.

    An unspecified encoding (null) counts on lines of ASCII, where all agree.
    """
    size, ascii_ = F.octet_length(line), F.octet_length(line) == F.char_length(line)
    plain = F.when((character >= 0) & (character <= size), character)
    following = F.hex(F.substring(F.encode(line, "UTF-8"), character.cast("int") + 1, F.lit(1)))
    utf8 = F.when((following >= "80") & (following < "C0"), F.lit(None).cast("long")).otherwise(plain)
    utf32 = F.when((character >= 0) & (character <= F.char_length(line)), F.octet_length(F.substring(line, F.lit(1), character.cast("int"))).cast("long"))
    start = F.struct(F.lit(0).cast("long").alias("units"), F.lit(0).cast("long").alias("bytes"))
    walked = F.aggregate(
        F.filter(F.split(line, ""), lambda c: c != ""), start,
        lambda s, c: F.when(s["units"] >= character, s).otherwise(F.struct((s["units"] + F.when(F.octet_length(c) == 4, 2).otherwise(1)).alias("units"), (s["bytes"] + F.octet_length(c)).alias("bytes"))),
    )
    utf16 = F.when((character >= 0) & (walked["units"] == character), walked["bytes"])
    return F.when(ascii_ & (encoding.isNull() | encoding.isin("utf-8", "utf-16", "utf-32")), plain).when(encoding == "utf-8", utf8).when(encoding == "utf-16", utf16).when(encoding == "utf-32", utf32)


def module_name(path: Column, package_files: tuple[str, ...] = ("__init__",)) -> Column:
    """Dotted name of a path: its trailing run of components that are identifiers; package files name their folder.  Empty where there is none."""
    parts = F.split(path, "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    names = F.when(stem.isin(*package_files), folders).otherwise(F.array_append(folders, stem))
    run = F.aggregate(
        F.reverse(names), F.struct(F.array().cast("array<string>").alias("out"), F.lit(True).alias("open")),
        lambda s, x: F.when(s["open"] & x.rlike(IDENTIFIER), F.struct(F.array_prepend(s["out"], x).alias("out"), F.lit(True).alias("open"))).otherwise(F.struct(s["out"].alias("out"), F.lit(False).alias("open"))),
    )
    return F.array_join(run["out"], ".")


def descriptors(path: Column) -> Column:
    """The ways an index spells a path's module: with slashes, dotted, dotted without an index file."""
    slash = F.regexp_replace(path, r"\.[^./]*$", "")
    every = F.array(slash, module_name(path), module_name(path, ("__init__", "index")))
    return F.array_distinct(F.filter(every, lambda x: x != ""))


def path_bound(scip: Column, path: Column) -> Column:
    """Whether a symbol's identity follows from its path: no index symbol, or one that spells the module at word boundaries."""
    spelled = F.exists(descriptors(path), lambda d: F.rlike(scip, F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), d, F.lit(r"\E(?![A-Za-z0-9_])"))))
    return F.when(scip.isNull(), F.lit(True)).otherwise(spelled)


def _percent(path: Column) -> Column:
    """Percent escapes in one form: unreserved characters as themselves, others with capital digits; null for a broken one or a separator."""
    pieces = F.split(path, "%")
    code = lambda x: F.upper(F.substring(x, 1, 2))
    char = lambda x: F.chr(F.conv(code(x), 16, 10).cast("int"))
    bad = lambda x: ~code(x).rlike("^[0-9A-F]{2}$") | code(x).isin("2F", "5C")
    shown = lambda x: F.when((F.conv(code(x), 16, 10).cast("int") < 128) & char(x).rlike(f"^{UNRESERVED}$"), char(x)).otherwise(F.concat(F.lit("%"), code(x)))
    rest = F.slice(pieces, F.lit(2), F.size(pieces) - 1)
    whole = F.concat(pieces[0], F.array_join(F.transform(rest, lambda x: F.concat(shown(x), F.substring(x, F.lit(3), F.char_length(x)))), ""))
    return F.when(~F.exists(rest, bad), whole)


def remote(url: Column) -> Column:
    """Struct host, owner, path of an https, ssh or scp-style remote; null for what is none, carries credentials, a query or a fragment, or a host that is not of DNS labels.

    Hosts are lower-cased without a final dot, default ports go, percent escapes take one form, a final .git goes.
    """
    u = F.trim(url)
    uri = lambda k: F.regexp_extract(u, r"^(https|ssh)://(?:([^@/]*)@)?([^@/:]+)(?::([0-9]+))?(/.*)$", k)
    scp = lambda k: F.regexp_extract(u, r"^(?:[^@/:\s]+@)?([^@/:\s]+):([^:\s]+)$", k)
    is_uri, is_scp = uri(1) != "", (scp(1) != "") & ~F.contains(u, F.lit("://"))
    host = F.regexp_replace(F.lower(F.when(is_uri, uri(3)).when(is_scp, scp(1))), r"[.]$", "")
    port = F.when(is_uri & (uri(4) != "") & ~(((uri(1) == "https") & (uri(4).cast("int") == 443)) | ((uri(1) == "ssh") & (uri(4).cast("int") == 22))), F.concat(F.lit(":"), uri(4).cast("int").cast("string"))).otherwise("")
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(_percent(F.when(is_uri, uri(5)).when(is_scp, scp(2))), "^/+|/+$", ""), "(?i)[.]git$", ""), "/+$", "")
    parts = F.split(path, "/")
    fine = ~u.rlike("[?#]") & (is_uri | is_scp) & ~((uri(1) == "https") & (uri(2) != "")) & ~F.contains(uri(2), F.lit(":")) & F.forall(F.split(host, r"[.]"), lambda x: x.rlike(SAFE_LABEL))
    named = (F.size(parts) >= 2) & F.forall(parts, lambda x: ~x.isin("", ".", "..")) & ~F.contains(path, F.lit("\\"))
    return F.when(fine & named, F.struct(F.concat(host, port).alias("host"), parts[0].alias("owner"), F.array_join(F.slice(parts, F.lit(2), F.size(parts) - 1), "/").alias("path")))
