"""Scalar column functions (all built-in expressions, no Python UDFs)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedyard import schemas as S


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()``: removes every Unicode whitespace at both ends.

    ``btrim`` with the explicit character set (no regex); Spark's plain ``trim``
    removes only spaces.
    """
    return F.btrim(_c(c), F.lit(S.WS_CHARS))


def sku_key(c) -> Column:
    """Case-insensitive catalog key: lower(strip(sku))."""
    return F.lower(py_strip(c))


def empty_to_null(c) -> Column:
    return F.nullif(py_strip(c), F.lit(""))


def lenient_flag(c) -> Column:
    """Import rule: FALSE only for a false token; anything else (even junk) is TRUE."""
    return ~F.coalesce(F.lower(py_strip(c)).isin(*S.FALSE_TOKENS), F.lit(False))


def strict_flag(c) -> Column:
    """Validator rule: TRUE / FALSE for known tokens, NULL otherwise (an error)."""
    t = F.lower(py_strip(c))
    return F.when(t.isin(*S.TRUE_TOKENS), F.lit(True)).when(t.isin(*S.FALSE_TOKENS), F.lit(False))


def text_in_bounds(stripped: Column) -> Column:
    n = F.length(stripped)
    return (n >= S.TEXT_MIN_LEN) & (n <= S.TEXT_MAX_LEN)


def percent(processed, total) -> Column:
    """processed / total * 100 rounded half-even to 2 places; 0 when total <= 0."""
    p, t = _c(processed), _c(total)
    return F.when(t > 0, F.bround(p.cast("double") / t * 100.0, 2)).otherwise(F.lit(0.0))


def longer_than(c, n: int) -> Column:
    """length(c) > n, reading at most n + 1 characters (bodies can be large)."""
    return F.substring(_c(c), n + 1, 1) != F.lit("")


def truncate_body(c) -> Column:
    """Over 1000 characters: the first 1000 plus the truncation suffix."""
    x = _c(c)
    return F.when(longer_than(x, S.BODY_LIMIT),
                  F.concat(F.substring(x, 1, S.BODY_LIMIT), F.lit(S.BODY_SUFFIX))).otherwise(x)


def cut_text(c, n: int = S.BODY_LIMIT) -> Column:
    """The first n characters, no suffix."""
    return F.substring(_c(c), 1, n)


def error_text(type_name, message) -> Column:
    return F.concat_ws(": ", _c(type_name), _c(message))


def progress_keys(job_id) -> tuple[Column, Column]:
    j = _c(job_id)
    return (F.concat(F.lit(f"{S.KEY_NAMESPACE}:hash:"), j),
            F.concat(F.lit(f"{S.KEY_NAMESPACE}:channel:"), j))


def size_mb(nbytes) -> Column:
    return F.format_string("%.2f", _c(nbytes) / (1024.0 * 1024.0))


def like_escape(text: str) -> str:
    """Make filter text safe for Spark's LIKE with backslash as the escape.

    ``%`` and ``_`` keep acting as wildcards (as in the reproduced service);
    ``\\%``, ``\\_`` and ``\\\\`` stay escapes; ``\\x`` becomes ``x``; a trailing
    backslash is kept and escapes the closing ``%`` (a literal percent sign).
    """
    out, i = [], 0
    while i < len(text):
        ch = text[i]
        if ch == "\\":
            if i + 1 < len(text):
                nxt = text[i + 1]
                out.append("\\" + nxt if nxt in "%_\\" else nxt)
                i += 2
                continue
            out.append("\\")  # joins the closing % as an escaped literal %
            i += 1
            continue
        out.append(ch)
        i += 1
    return "".join(out)


def contains_ci(c, text: str) -> Column:
    """Case-insensitive ``%text%`` match (ILIKE)."""
    return _c(c).ilike("%" + like_escape(text) + "%")
