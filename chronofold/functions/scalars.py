"""Scalar functions as column expressions: identities, text rules, keys and limits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LANGUAGES = {"py": "python", "ts": "typescript", "js": "javascript", "go": "go", "html": "html"}


def length_prefixed(*parts: Column) -> Column:
    """Injective encoding of a tuple: ``<utf8 bytes>:<text>`` joined by commas; a null part is ``-``."""
    return F.concat_ws(",", *[F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts])


def uuid5(namespace: str, name: Column) -> Column:
    """Name-based UUID, version 5, of a string column."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(63).bitwiseOR(128)))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 19, 2), F.lit("-"), F.substring(h, 21, 12))


def canonical_event(*columns: str) -> Column:
    """Canonical JSON of fixed scalar columns (sorted names, no spaces) and its SHA-256 is the row's claim digest."""
    return F.to_json(F.struct(*sorted(columns)))


def clean_text(text: Column, limit: int) -> Column:
    """Control, format and space characters become one space; ends trimmed; cut with an ellipsis."""
    out = F.trim(F.regexp_replace(text, r"[\p{C}\p{Z}]+", " "))
    return F.when(F.char_length(out) > limit, F.concat(F.substring(out, 1, limit - 1), F.lit("…"))).otherwise(out)


def closed_label(value: Column, allowed: list[str]) -> Column:
    return F.when(value.isin(allowed), value).otherwise("other")


def language_of(path: Column) -> Column:
    ext = F.regexp_extract(path, r"\.([A-Za-z]+)$", 1)
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return table[ext]


def module_of(path: Column) -> Column:
    """Dotted module of a path: suffix and index forms dropped."""
    return F.replace(F.regexp_replace(F.regexp_replace(path, r"\.[A-Za-z]+$", ""), r"/(__init__|index)$", ""), F.lit("/"), F.lit("."))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.octet_length(text) / 4).cast("long")


def backoff_ms(attempt: Column, base: int, most: int) -> Column:
    """min(base * 2^(attempt - 1), most), the exponent held at 62."""
    return F.least(F.lit(float(most)), F.lit(float(base)) * F.pow(F.lit(2.0), F.least(attempt - 1, F.lit(62)))).cast("long")


def object_key(digest: Column) -> Column:
    return F.concat(F.lit("sha256/"), F.substring(digest, 1, 2), F.lit("/"), F.substring(digest, 3, 2), F.lit("/"), digest, F.lit(".zst"))


def normal_url(url: Column) -> Column:
    """scheme-free host and path: lower-case host, default port, query, fragment and final slash dropped."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#]+)", 1)), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]+([^?#]*)", 1), r"/+$", "")
    return F.concat(host, path)


def query_tokens(text: Column, stop: list[str], most: int = 16) -> Column:
    """Camel case split, lower-cased words of 2 to 48 characters, no stop words, the first ``most`` distinct."""
    split = F.regexp_replace(text, r"(?<=[a-z0-9])(?=[A-Z])", " ")
    words = F.regexp_extract_all(F.lower(split), F.lit("[0-9a-zà-öø-ÿ]+"), F.lit(0))
    return F.slice(F.array_distinct(F.filter(words, lambda w: (F.char_length(w) >= 2) & (F.char_length(w) <= 48) & ~w.isin(stop))), 1, most)


def git_blob_id(data: Column) -> Column:
    """SHA-1 of ``blob <size>`` NUL and the bytes."""
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(data).cast("string")), "UTF-8"), F.unhex(F.lit("00")), data))
