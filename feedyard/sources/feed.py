"""Catalog feed source (CSV files): listing, per-file facts, scan and row ordinals.

Design notes
* One text pass gives per-file facts: header line, whether any physical line has an
  odd number of quotes (a quoted newline, so the file needs the multiLine reader),
  and whether any line's raw bytes are not valid UTF-8 (`is_valid_utf8`).  Files are
  listed by Spark (binaryFile without content), so facts are a table from the start.
* One CSV scan with a positional all-STRING schema as wide as the widest header reads
  the feed; header names are matched exactly and case-sensitively by us (not by
  Spark), and each file's column positions are looked up in the facts.  Files with
  quoted newlines are read by a second scan, with multiLine.
* Row ordinals (1-based row number inside a file) use block offsets: an id taken at
  the scan, a tiny per-(file, block) count table, a running sum over blocks.  No
  global sort and no single-partition window.
"""
from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedyard import schemas as S
from feedyard.operators.ordering import global_rank

READ_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": "_raw",
    "encoding": "UTF-8",
    "recursiveFileLookup": "true",
}
_QUOTED = r'"(?:[^"]|"")*"'
# Above this many rows a lookup table is joined by shuffle, not broadcast.
SMALL_TABLE_ROWS = 2_000_000


def list_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """File listing (path, length, modified_at) by Spark's own file index, zero-length files
    (empty feeds) included; the content is not selected, so nothing is read."""
    from feedyard.session import path_exists
    there = [p for p in ([path] if isinstance(path, str) else path) if path_exists(spark, p)]
    if not there:
        return spark.createDataFrame([], "path string, length long, modified_at timestamp")
    index = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(there)
    files = index.select("path", "length", F.col("modificationTime").alias("modified_at"))
    # scans leave out zero-length files; the index that Spark keeps on the driver has their names
    names = [(re.sub("^file:/+", "file:/", unquote(n)),) for n in index.inputFiles()]
    return (spark.createDataFrame(names, "path string").join(files, "path", "left")
            .select("path", F.coalesce("length", F.lit(0)).alias("length"), F.coalesce("modified_at", F.timestamp_seconds(F.lit(0))).alias("modified_at")))


def header_names(header_line: Column) -> Column:
    """Split a header line at the commas outside quotes; drops a UTF-8 byte-order mark and
    outer quotes, and undoubles quotes inside."""
    line = F.regexp_replace(header_line, "^﻿", "")
    names = F.split(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)')
    return F.transform(names, lambda x: F.when(
        x.rlike('^".*"$'), F.replace(F.regexp_replace(x, r'^"(.*)"$', "$1"), F.lit('""'), F.lit('"'))).otherwise(x))


def file_facts(spark: SparkSession, path: str | list[str], in_order: bool = False) -> DataFrame:
    """One row per listed file: header, names, multiLine need, bad bytes, line count; ranked
    by path, or by (modification time, path) with `in_order`."""
    lines = (spark.read.option("recursiveFileLookup", "true").text(path)
             .select(F.col("value"),
                     F.col("_metadata.file_path").alias("path"),
                     F.col("_metadata.file_block_start").alias("bs"),
                     F.monotonically_increasing_id().alias("m")))
    quotes = F.length("value") - F.length(F.regexp_replace("value", '"', ""))
    per_file = lines.groupBy("path").agg(
        F.min_by("value", F.when(F.col("bs") == 0, F.col("m"))).alias("header_line"),
        F.max((quotes % 2) == 1).alias("multiline"),
        F.max(~F.is_valid_utf8("value")).alias("bad_utf8"),  # text lines keep raw bytes
        F.count("*").alias("n_lines"),
    )
    files = list_files(spark, path)
    return (files.join(per_file, "path", "left")
            .withColumn("multiline", F.coalesce("multiline", F.lit(False)))
            .withColumn("bad_utf8", F.coalesce("bad_utf8", F.lit(False)))
            .withColumn("n_lines", F.coalesce("n_lines", F.lit(0)))
            .withColumn("names", F.when(F.col("header_line").isNotNull()
                                        & (F.col("header_line") != ""),
                                        header_names(F.col("header_line"))))
            .transform(lambda f: global_rank(f, ["modified_at", "path"] if in_order else ["path"], "file_rank"))
            .withColumn("file_rank", F.col("file_rank").cast("int")))


def _field_count(raw: Column) -> Column:
    """Fields in a raw CSV record: commas outside quoted parts + 1."""
    bare = F.regexp_replace(raw, _QUOTED, "")
    return F.length(bare) - F.length(F.regexp_replace(bare, ",", "")) + 1


def _position(name: str) -> Column:
    """1-based position of the last header column called `name`, 0 when there is none."""
    back = F.array_position(F.reverse("names"), name)
    return F.when(back > 0, F.size("names") + 1 - back).otherwise(0).cast("int")


def readable(facts: DataFrame) -> DataFrame:
    """Files whose rows can be read: rank, reader kind and the positions of the allowed columns."""
    return (facts.filter(F.col("names").isNotNull() & ~F.col("bad_utf8"))
            .select("path", "file_rank", "multiline", *[_position(c).alias(f"{c}_pos") for c in S.ALLOWED_HEADERS]))


def scan(spark: SparkSession, paths: str | list[str], width: int, multiline: bool) -> DataFrame:
    """Every record of the files: block start, scan id, number of fields and the cells.

    Cells are NULL both when empty and when missing; the number of fields tells them apart
    (a short row lacks the trailing ones).
    """
    cells = [f"c{i}" for i in range(1, width + 1)]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*cells, "_raw"]])
    df = spark.read.schema(schema).options(**READ_OPTIONS).option("multiLine", "true" if multiline else "false").csv(paths)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("bs"),
                     F.monotonically_increasing_id().alias("m1"),
                     F.when(F.col("_raw").isNull(), F.lit(width)).otherwise(_field_count(F.col("_raw"))).alias("n_fields"),
                     F.array(*cells).alias("cells"))


def shape(facts: DataFrame):
    """Files, readable files, those of them with quoted newlines, and the widest header."""
    ok = F.col("names").isNotNull() & ~F.col("bad_utf8")
    return facts.agg(F.count("*").alias("files"), F.count_if(ok).alias("n"), F.count_if(ok & F.col("multiline")).alias("multi"),
                     F.greatest(F.lit(1), F.coalesce(F.max(F.when(ok, F.size("names"))), F.lit(1))).alias("width")).first()


def scan_feed(spark: SparkSession, path: str | list[str], facts: DataFrame, n) -> DataFrame:
    """Rows of all readable files with the allowed columns (`<c>_v`, `<c>_present`,
    `<c>_in_header`); `facts` should be staged, `n` is its `shape`."""
    files = readable(facts)
    width = n["width"]
    lookup = F.broadcast(files) if n["files"] <= SMALL_TABLE_ROWS else files  # one narrow row a file
    rows = None
    if n["n"] > n["multi"]:
        rows = scan(spark, path, width, False).join(lookup.filter("not multiline"), "path")
    if n["multi"]:  # names of the files with quoted newlines only
        names = [r["path"] for r in files.filter("multiline").select("path").collect()]
        more = scan(spark, names, width, True).join(lookup.filter("multiline"), "path")
        rows = more if rows is None else rows.unionByName(more)
    if rows is None:  # no file passed the header gate
        rows = spark.createDataFrame([], "path string, bs long, m1 long, n_fields int, cells array<string>").join(lookup, "path")
    cols = []
    for c in S.ALLOWED_HEADERS:
        pos = F.col(f"{c}_pos")
        cols += [F.get("cells", pos - 1).alias(f"{c}_v"), ((pos > 0) & (F.col("n_fields") >= pos)).alias(f"{c}_present"),
                 (pos > 0).alias(f"{c}_in_header")]
    return rows.select("path", "file_rank", "bs", "m1", "n_fields", *cols)


def missing_paths(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Requested paths that do not exist (checked on the driver: names only)."""
    from feedyard.session import path_exists
    gone = [p for p in paths if not path_exists(spark, p)]
    return spark.createDataFrame([(p,) for p in gone], "path string")


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner",
               max_rows: int = SMALL_TABLE_ROWS) -> DataFrame:
    """Join a lookup table; broadcast it only after checking its row count."""
    n = small.count()
    return big.join(F.broadcast(small) if n <= max_rows else small, on, how)


def block_offsets(rows: DataFrame, id_col: str, prefix: str, file_col: str = "file_rank") -> DataFrame:
    """Per (file, block): rows, first id and offset of the block inside its file.

    One row per file block (input size / block size rows), keyed by integers.
    """
    blocks = rows.groupBy(file_col, "bs").agg(F.count("*").alias(f"{prefix}_n"),
                                              F.min(id_col).alias(f"{prefix}_min"))
    w = Window.partitionBy(file_col).orderBy("bs").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn(f"{prefix}_off", F.coalesce(F.sum(f"{prefix}_n").over(w), F.lit(0)))


def with_ordinals(rows: DataFrame, file_col: str = "file_rank") -> DataFrame:
    """Adds `ord`: 1-based row number within its file (block-offset method)."""
    blocks = block_offsets(rows, "m1", "blk", file_col)
    return (join_small(rows, blocks.select(file_col, "bs", "blk_min", "blk_off"), [file_col, "bs"])
            .withColumn("ord", F.col("blk_off") + F.col("m1") - F.col("blk_min") + 1)
            .drop("blk_min", "blk_off"))
