"""Feed validation report: file gates, header rules, sample-row rules, error cap, verdict.

Messages follow the reproduced validator word for word, except the encoding error,
whose decoder detail (byte and position) is replaced by a fixed text.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedyard import schemas as S
from feedyard.functions import text as X

MB = 1024.0 * 1024.0
ENCODING_ERROR = "File encoding error: invalid UTF-8 bytes. File must be UTF-8 encoded"
STOP_SEQ = 99


def file_gates(facts: DataFrame, max_mb: float | None = None) -> DataFrame:
    """Per file: the first failing gate (or NULL) and the unknown-header warning.  The size
    gate is off unless `max_mb` is given."""
    names = F.col("names")
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    missing = F.array_sort(F.array_except(F.array(*[F.lit(h) for h in S.REQUIRED_HEADERS]), names))
    found = F.array_sort(F.array_distinct(names))
    unknown = F.array_sort(F.array_except(F.array_distinct(names),
                                          F.array(*[F.lit(h) for h in S.ALLOWED_HEADERS])))
    gate = (F.when(ext != ".csv", F.format_string(S.MSG_BAD_EXTENSION, ext))
            .when(F.lit(max_mb is not None) & (F.col("length") / MB > F.lit(float(max_mb or 0))),
                  F.format_string(S.MSG_TOO_BIG, F.col("length") / MB, F.lit(f"{max_mb or 0:g}")))
            .when(F.col("bad_utf8"), F.lit(ENCODING_ERROR))
            .when(names.isNull(), F.lit(S.MSG_NO_HEADER))
            .when(F.size(missing) > 0,
                  F.format_string(S.MSG_MISSING_HEADERS, F.array_join(missing, ", "), F.array_join(found, ", "))))
    warning = F.when(gate.isNull() & (F.size(unknown) > 0),
                     F.format_string(S.MSG_UNKNOWN_HEADERS, F.array_join(unknown, ", ")))
    return facts.select("path", "file_rank", gate.alias("gate_error"), warning.alias("warning"))


def _field_message(field: str) -> Column:
    v = X.py_strip(F.coalesce(F.col(f"{field}_v"), F.lit("")))
    msg = (F.when(~F.col(f"{field}_present"), F.lit(S.MSG_NOT_STRING))
           .when(F.length(v) < S.TEXT_MIN_LEN, F.lit(S.MSG_TOO_SHORT))
           .when(F.length(v) > S.TEXT_MAX_LEN, F.lit(S.MSG_TOO_LONG)))
    return F.when(msg.isNotNull(), F.format_string(S.MSG_FIELD, F.col("ord"), F.lit(field), msg))


def _running(s: DataFrame, block: int | None) -> DataFrame:
    """Adds `cum`: the messages of the file up to and with the row.  With `block`, in two levels:
    counts inside blocks of that many ordinals, a running sum over the file's blocks (one narrow
    row a block) and these offsets joined back, so that no window group exceeds a block."""
    local = F.sum(F.size("msgs")).over(Window.partitionBy("file_rank", "_blk").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    if block is None:
        return s.withColumn("_blk", F.lit(0)).withColumn("cum", local).drop("_blk")
    s = s.withColumn("_blk", F.floor(F.col("ord") / block))
    before = Window.partitionBy("file_rank").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (s.groupBy("file_rank", "_blk").agg(F.sum(F.size("msgs")).alias("_n"))
               .withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    return (s.withColumn("cum", local).join(offsets, ["file_rank", "_blk"])
            .withColumn("cum", F.col("cum") + F.col("_off")).drop("_blk", "_off"))


#: Ordinals of a file that one window group spans at most when a whole feed is validated.
MESSAGE_BLOCK = 100_000


def sample_messages(rows: DataFrame, sample_size: int | None = S.SAMPLE_SIZE,
                    max_errors: int | None = S.MAX_SAMPLE_ERRORS, block: int = MESSAGE_BLOCK) -> DataFrame:
    """Row messages of the sample, cut after the first row that brings the count to the cap.

    Returns (file_rank, line, seq, message, error_no) plus one row per file where the
    reading stops; error_no counts the file's row messages.  With sample_size=None the
    whole feed is validated, with max_errors=None nothing is cut.  Only rows with messages
    are counted, in blocks of `block` ordinals.
    """
    s = rows if sample_size is None else rows.filter(F.col("ord") <= sample_size)
    token = F.lower(X.py_strip(F.coalesce(F.col("active_v"), F.lit(""))))
    bad_active = F.col("active_in_header") & (
        ~F.col("active_present") | ~token.isin(*S.TRUE_TOKENS, *S.FALSE_TOKENS))
    shown = F.when(F.col("active_present"), F.coalesce(F.col("active_v"), F.lit(""))).otherwise(F.lit("None"))
    v4 = F.format_string(S.MSG_UNEXPECTED, F.col("ord"), shown)
    v2 = F.filter(F.array(_field_message("sku"), _field_message("name")), lambda x: x.isNotNull())
    s = s.select("file_rank", "ord",
                 F.when(bad_active, F.array(v4)).otherwise(v2).alias("msgs"),
                 (~bad_active & (F.size(v2) > 0)).alias("has_field_errors")).filter(F.size("msgs") > 0)
    small = sample_size is not None and sample_size <= block
    s = _running(s, None if small else block)
    if max_errors is not None:
        stop = F.min(F.when(F.col("has_field_errors") & (F.col("cum") >= max_errors), F.col("ord")))
        s = (s.withColumn("stop_ord", stop.over(Window.partitionBy("file_rank"))) if small
             else s.join(s.groupBy("file_rank").agg(stop.alias("stop_ord")), "file_rank", "left"))
        s = s.filter(F.col("stop_ord").isNull() | (F.col("ord") <= F.col("stop_ord")))
    else:
        s = s.withColumn("stop_ord", F.lit(None).cast("long"))
    seq = F.col("pos") + 1
    msgs = s.select("file_rank", F.col("ord").alias("line"), "cum", F.size("msgs").alias("n"),
                    F.posexplode("msgs").alias("pos", "message"))
    msgs = msgs.select("file_rank", "line", seq.alias("seq"), "message", (F.col("cum") - F.col("n") + seq).alias("error_no"))
    if max_errors is None:
        return msgs
    stops = (s.filter(F.col("ord") == F.col("stop_ord"))
             .select("file_rank", F.col("ord").alias("line"), F.lit(STOP_SEQ).alias("seq"),
                     F.lit(S.MSG_STOPPED).alias("message"), F.col("cum").alias("error_no")))
    return msgs.unionByName(stops)


def validation_errors(facts: DataFrame, rows: DataFrame, sample_size: int | None = S.SAMPLE_SIZE,
                      max_mb: float | None = None, max_errors: int | None = S.MAX_SAMPLE_ERRORS) -> DataFrame:
    """V6 as rows: the gate error or header warning of each file (line 0), then its row messages."""
    gates = file_gates(facts, max_mb)
    head = gates.select("file_rank", F.lit(0).cast("long").alias("line"), F.lit(0).alias("seq"),
                        F.coalesce("gate_error", "warning").alias("message"),
                        F.lit(0).cast("long").alias("error_no")).filter(F.col("message").isNotNull())
    ok = gates.filter(F.col("gate_error").isNull()).select("file_rank")
    from feedyard.sources.feed import join_small
    body = sample_messages(join_small(rows, ok, "file_rank", "left_semi"), sample_size, max_errors)
    return (head.unionByName(body)
            .withColumn("is_warning", F.col("message").startswith(S.MSG_WARNING_PREFIX)))


def verdict(facts: DataFrame, rows: DataFrame, sample_size: int = S.SAMPLE_SIZE,
            max_mb: float | None = None) -> DataFrame:
    errs = validation_errors(facts, rows, sample_size, max_mb)
    per_file_errs = errs.groupBy("file_rank").agg(
        F.count("*").alias("n_messages"),
        F.count_if(~F.col("is_warning")).alias("n_errors"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "seq", "message"))),
                                 lambda x: x["message"]), "\n").alias("errors"),
        F.max(F.when(F.col("seq") == STOP_SEQ, F.col("line"))).alias("stop_ord"))
    counts = rows.groupBy("file_rank").agg(F.count("*").alias("n_rows"))
    g = file_gates(facts, max_mb)
    out = (g.join(counts, "file_rank", "left").join(per_file_errs, "file_rank", "left"))
    failed = F.col("gate_error").isNotNull()
    total = F.when(failed, F.lit(0)).otherwise(F.coalesce("n_rows", F.lit(0))).cast("long")
    return out.select(
        "file_rank",
        (F.coalesce("n_errors", F.lit(0)) == 0).alias("is_valid"),
        F.coalesce("n_messages", F.lit(0)).alias("n_messages"),
        F.coalesce("errors", F.lit("")).alias("errors"),
        total.alias("total_rows"),
        F.when(failed, F.lit(0)).otherwise(F.coalesce(F.col("stop_ord"), F.least(total, F.lit(sample_size))))
        .cast("long").alias("sample_size"),
    )


def missing_file_errors(missing: DataFrame) -> DataFrame:
    """S2 for requested paths that do not exist: the extension rule is checked first."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    return missing.select(
        "path",
        F.when(ext != ".csv", F.format_string(S.MSG_BAD_EXTENSION, ext))
        .otherwise(F.format_string(S.MSG_FILE_NOT_FOUND, F.col("path"))).alias("message"),
        F.lit(False).alias("is_valid"))
