"""Content-derived identifiers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: namespace of vector-point identifiers (the DNS namespace of RFC 4122).
POINT_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def data_hash(fields: Mapping[str, Column]) -> Column:
    """SHA-256 of the fields as JSON with sorted keys, no spaces, and null kept.

    Give strings and integers only: other types print differently from one engine to the next.
    """
    ordered = F.struct(*(fields[name].alias(name) for name in sorted(fields)))
    return F.sha2(F.to_json(ordered, {"ignoreNullFields": "false"}), 256)


def chunk_id(fields: Mapping[str, Column]) -> Column:
    return F.concat(F.lit("chunk-"), F.substring(data_hash(fields), 1, 24))


def build_id(*parts: Column, length: int = 12) -> Column:
    """First characters of the SHA-256 of the parts joined by bars."""
    return F.substring(F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256), 1, length)


def uuid5(name: Column, namespace: str = POINT_NAMESPACE) -> Column:
    """Version 5 UUID of a name."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    cut = lambda a, n: F.substring(digest, a, n)
    return F.concat_ws("-", cut(1, 8), cut(9, 4), F.concat(F.lit("5"), cut(14, 3)), F.concat(variant, cut(18, 3)), cut(21, 12))


def citation_id(act: Column, year: Column, source_sha256: Column, number: Column) -> Column:
    return F.concat_ws("-", act, year.cast("string"), F.substring(source_sha256, 1, 12), F.concat(F.lit("S"), number))
