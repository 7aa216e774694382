"""Row cleaning for catalog feeds (whole-feed form of the per-row import rules).

Outcome per row, tested in this order:
  skipped   sku or name empty or missing (before strip) - silently dropped
  rejected  description column in the header but missing in a short row,
            or sku / name outside 1..255 characters after strip
  accepted  everything else; active is lenient (only false tokens give FALSE)
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedyard.functions import text as X


def _blank(c: str) -> Column:
    return F.col(c).isNull() | (F.col(c) == "")


def classify(rows: DataFrame) -> DataFrame:
    """Adds outcome, reason and the cleaned sku / name / description / active / sku_key."""
    sku_s, name_s = X.py_strip("sku_v"), X.py_strip("name_v")
    skip = _blank("sku_v") | _blank("name_v")
    desc_missing = F.col("description_in_header") & ~F.col("description_present")
    sku_bad, name_bad = ~X.text_in_bounds(sku_s), ~X.text_in_bounds(name_s)
    outcome = (F.when(skip, "skipped")
               .when(desc_missing | sku_bad | name_bad, "rejected")
               .otherwise("accepted"))
    reason = (F.when(skip, "missing_sku_or_name")
              .when(desc_missing, "description_missing")
              .when(sku_bad | name_bad,
                    F.concat_ws(",", F.when(sku_bad, F.lit("sku_length")),
                                F.when(name_bad, F.lit("name_length")))))
    ok = outcome == "accepted"
    return rows.select(
        "*",
        outcome.alias("outcome"),
        reason.alias("reason"),
        F.when(ok, sku_s).alias("sku"),
        F.when(ok, name_s).alias("name"),
        F.when(ok, X.empty_to_null("description_v")).alias("description"),
        F.when(ok, X.lenient_flag("active_v")).alias("active"),
        F.when(ok, F.lower(sku_s)).alias("sku_key"),
    )


def accepted(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("outcome") == "accepted")


def quarantine(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("outcome") == "rejected")


def outcome_summary(rows: DataFrame) -> DataFrame:
    """Per file: rows, accepted (= processed), skipped and rejected counts."""
    return rows.groupBy("file_rank").agg(
        F.count("*").alias("total_rows"),
        F.count_if(F.col("outcome") == "accepted").alias("processed_rows"),
        F.count_if(F.col("outcome") == "skipped").alias("skipped_rows"),
        F.count_if(F.col("outcome") == "rejected").alias("rejected_rows"),
    )
