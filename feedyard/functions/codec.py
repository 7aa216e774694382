"""JSON value codec of the progress hash (decode falls back to the raw text)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def encode(c) -> Column:
    """JSON text of one value (strings quoted and escaped, numbers as they are)."""
    return F.regexp_extract(F.to_json(F.array(_c(c))), r"^\[(.*)\]$", 1)


def decode_text(c) -> Column:
    """Decoded value as text: a JSON value (`null` is NULL), or the raw text where it is no JSON."""
    v = F.try_parse_json(_c(c))
    return F.when(v.isNotNull(), F.try_variant_get(v, "$", "string")).otherwise(_c(c))


def is_json(c) -> Column:
    return F.try_parse_json(_c(c)).isNotNull()


def decode_long(c) -> Column:
    return F.try_variant_get(F.try_parse_json(_c(c)), "$", "long")


def get_long(c, path: str) -> Column:
    return F.try_variant_get(F.try_parse_json(_c(c)), path, "long")
