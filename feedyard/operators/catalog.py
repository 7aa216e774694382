"""Catalog reads: filtered listing, page facts, counts and lookups."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedyard import schemas as S
from feedyard.functions import text as X


@dataclass(frozen=True)
class ProductFilter:
    sku: str | None = None
    name: str | None = None
    description: str | None = None
    active: bool | None = None


def apply_filter(table: DataFrame, f: ProductFilter) -> DataFrame:
    """Filters AND together; `%` and `_` in the text stay wildcards."""
    out = table
    if f.sku is not None:
        out = out.filter(X.contains_ci("sku", f.sku))
    if f.name is not None:
        out = out.filter(X.contains_ci("name", f.name))
    if f.description is not None:
        out = out.filter(F.col("description").isNotNull() & X.contains_ci("description", f.description))
    if f.active is not None:
        out = out.filter(F.col("active") == F.lit(f.active))
    return out


def newest_first(df: DataFrame, ts: str = "created_at", tie: str = "id") -> DataFrame:
    """O1: newest first; the id tie-break makes pages deterministic."""
    return df.orderBy(F.col(ts).desc(), F.col(tie).desc())


def check_page(page: int, page_size: int, max_size: int = S.PAGE_SIZE_MAX) -> None:
    if page < 1 or not (1 <= page_size <= max_size):
        raise ValueError(f"page must be >= 1 and 1 <= page_size <= {max_size}")


DEEP_PAGE_ROWS = 10_000
#: Ranges of one histogram of `seek`: at most so many counts reach the driver.
SEEK_RANGES = 1024


def _locate(rows: DataFrame, key: Column, below, position: int, most: int) -> tuple[int, int, int] | None:
    """(lowest, highest, rows before) of a range of the integer `key` that holds the row at
    `position` in descending order: at most `most` rows, or one value of the key.

    Each step counts the rows of at most `SEEK_RANGES` equal ranges and goes on in the one
    that holds the position; `below(lo, hi)` is its filter on the column itself, which
    reaches the scan.
    """
    ends = rows.agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count("*").alias("n")).first()
    if position >= ends["n"]:
        return None
    lo, hi, n, before = ends["lo"], ends["hi"], ends["n"], 0
    while n > most and lo < hi:
        width = -(-(hi - lo + 1) // SEEK_RANGES)
        place = F.floor((F.lit(hi) - key) / F.lit(width)) if width > 1 else F.lit(hi) - key
        counts = rows.filter(below(lo, hi)).groupBy(place.cast("long").alias("r")).count().collect()  # at most SEEK_RANGES rows
        for r, n in sorted((c["r"], c["count"]) for c in counts):
            if position < before + n:
                break
            before += n
        lo, hi = max(lo, hi - (r + 1) * width + 1), hi - r * width
    return lo, hi, before


def seek(rows: DataFrame, offset: int, size: int, ts: str = "created_at", tie: str = "id", most: int = DEEP_PAGE_ROWS) -> tuple[DataFrame, int]:
    """(rows of the (ts, tie) range that holds the page, the page's offset in them).

    The range is found by histograms of counts, so nothing is sorted but the range: about
    2 `most` + `size` rows, however deep the page.  Neither column may hold nulls.
    """
    at = lambda v: F.timestamp_micros(F.lit(v))
    by_ts = lambda lo, hi: (F.col(ts) >= at(lo)) & (F.col(ts) <= at(hi))
    by_tie = lambda lo, hi: (F.col(tie) >= F.lit(lo)) & (F.col(tie) <= F.lit(hi))

    def find(position: int) -> tuple | None:
        got = _locate(rows, F.unix_micros(ts), by_ts, position, most)
        if got is None or got[0] < got[1]:
            return got and (got[0], got[1], None, None, got[2])
        lo, hi, before = got  # one time: its rows by the tie
        inside = _locate(rows.filter(F.col(ts) == at(lo)), F.col(tie).cast("long"), by_tie, position - before, most)
        return lo, hi, inside[0], inside[1], before + inside[2]

    first = find(offset)
    if first is None:
        return rows.filter(F.lit(False)), 0
    last = find(offset + size - 1)
    out = rows.filter(F.col(ts) <= at(first[1]))
    if first[3] is not None:
        out = out.filter((F.col(ts) < at(first[1])) | (F.col(tie) <= F.lit(first[3])))
    if last is not None:
        out = out.filter(F.col(ts) >= at(last[0]))
        if last[2] is not None:
            out = out.filter((F.col(ts) > at(last[0])) | (F.col(tie) >= F.lit(last[2])))
    return out, offset - first[4]


def page(table: DataFrame, f: ProductFilter, page_no: int = 1,
         page_size: int = S.PAGE_SIZE_DEFAULT, deep_rows: int = DEEP_PAGE_ROWS) -> DataFrame:
    """O2: one page, newest first; filters are pushed to the scan.

    Shallow pages plan as a top-k (each task keeps offset + size rows).  Pages that end
    beyond `deep_rows` seek the range of (created_at, id) that holds them first, so that
    the top-k works on that range alone.
    """
    check_page(page_no, page_size)
    offset = (page_no - 1) * page_size
    rows = apply_filter(table, f)
    if offset + page_size > deep_rows:
        rows, offset = seek(rows, offset, page_size, most=deep_rows)
    return newest_first(rows).offset(offset).limit(page_size)


def page_facts(table: DataFrame, f: ProductFilter, page_no: int = 1,
               page_size: int = S.PAGE_SIZE_DEFAULT) -> DataFrame:
    """O3 / A2: total, total pages, next / previous and the 'showing a to b of n' bounds."""
    check_page(page_no, page_size)
    total = F.col("total")
    pages = F.ceil(total / F.lit(page_size)).cast("long")
    return apply_filter(table, f).agg(F.count("*").alias("total")).select(
        "total",
        F.lit(page_no).alias("page"),
        F.lit(page_size).alias("page_size"),
        pages.alias("total_pages"),
        (F.lit(page_no) < pages).alias("has_next"),
        F.lit(page_no > 1).alias("has_previous"),
        F.lit((page_no - 1) * page_size + 1).cast("long").alias("showing_from"),
        F.least(F.lit(page_no * page_size).cast("long"), total).alias("showing_to"),
    )


def count_all(table: DataFrame) -> DataFrame:
    """A1."""
    return table.agg(F.count("*").alias("total"))


def lookup_ids(table: DataFrame, ids: DataFrame) -> DataFrame:
    """P12 as a table job: each requested id with its row, or found = FALSE."""
    req = ids.select(F.col("id")).distinct()
    return (req.join(table, "id", "left")
            .select("id", F.col("sku_key").isNotNull().alias("found"), "sku", "name"))


def lookup_skus(table: DataFrame, args: DataFrame) -> DataFrame:
    """lower(sku) = lower(arg); the argument is not stripped."""
    req = args.select("arg").distinct().withColumn("sku_key", F.lower("arg"))
    return (req.join(table.select("sku_key", "id", "sku"), "sku_key", "left")
            .select("arg", F.col("id").isNotNull().alias("found"), "id", "sku"))
