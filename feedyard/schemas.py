"""Table schemas and fixed values.

FIXED VALUES — these must equal the behaviour being reproduced (header names,
flag tokens, limits, status names, messages).  Stated plainly, in natural order.
"""
from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values: feed headers -------------------------------------------
REQUIRED_HEADERS = ("sku", "name")
OPTIONAL_HEADERS = ("description", "active")
ALLOWED_HEADERS = ("sku", "name", "description", "active")

# ---- fixed values: flag tokens (compared after strip + lower) ----------------
TRUE_TOKENS = ("true", "yes", "1", "t", "y")
FALSE_TOKENS = ("false", "no", "0", "f", "n")

# ---- fixed values: limits -------------------------------------------------------
SAMPLE_SIZE = 100          # rows checked by the feed validator
MAX_SAMPLE_ERRORS = 10     # validator stops after this many messages
TEXT_MIN_LEN = 1           # sku / name length bounds after strip
TEXT_MAX_LEN = 255
IMPORT_BATCH_SIZE = 10_000
DELETE_BATCH_SIZE = 10_000
PROGRESS_INTERVAL_S = 2.0
SNAPSHOT_TTL_S = 3600
MAX_FILE_MB = 100
BODY_LIMIT = 1000
BODY_SUFFIX = "... (truncated)"
MAX_RETRIES = 3
IMPORT_TRIES = 4
RECENT_JOBS = 50
PAGE_SIZE_DEFAULT = 20
PAGE_SIZE_MAX = 100
DELIVERY_PAGE_SIZE = 50
EDITOR_DESCRIPTION_MAX = 1000

# ---- fixed values: statuses and event types --------------------------------
JOB_STATUSES = ("queued", "uploading", "parsing", "importing", "done", "failed")
JOB_TYPES = ("import", "bulk_delete")
TERMINAL_STATUSES = ("done", "failed")
DELIVERY_STATUSES = ("pending", "success", "failed")
EVENT_TYPES = (
    "product.created",
    "product.updated",
    "product.deleted",
    "product.bulk_deleted",
    "import.completed",
    "import.failed",
)

# ---- fixed values: messages (printf-style formats) --------------------------
MSG_BAD_EXTENSION = "Invalid file extension: %s. Expected .csv"
MSG_FILE_NOT_FOUND = "File not found: %s"
MSG_TOO_BIG = "File size (%.2f MB) exceeds maximum allowed size (%s MB)"
MSG_NO_HEADER = "CSV file is empty or has no headers"
MSG_MISSING_HEADERS = "Missing required headers: %s. Found: %s"
MSG_UNKNOWN_HEADERS = "Warning: Unknown headers will be ignored: %s"
MSG_FIELD = "Row %d, field '%s': %s"
MSG_UNEXPECTED = "Row %d: Unexpected error - Cannot parse '%s' as boolean"
MSG_TOO_SHORT = "String should have at least 1 character"
MSG_TOO_LONG = "String should have at most 255 characters"
MSG_NOT_STRING = "Input should be a valid string"
MSG_STOPPED = "Validation stopped after 10 errors. Please fix these issues and retry."
MSG_WARNING_PREFIX = "Warning:"
MSG_IMPORT_FILE_MISSING = "CSV file not found at %s"
MSG_NOT_BULK_DELETE = "Job %s is not a bulk_delete job (type: %s)"
KEY_NAMESPACE = "import_progress"

# ---- fixed values: progress stages -------------------------------------------
STAGE_STARTING = "starting"
STAGE_BATCH = "batch_%d"
STAGE_BATCH_FINAL = "batch_%d_final"
STAGE_COMPLETED = "completed"
STAGE_COUNTING = "counting"
STAGE_QUEUED = "queued"

# ---- fixed values: client display -----------------------------------------------
DISPLAY_STATUS = {"done": "completed", "failed": "failed", "queued": "importing", "uploading": "importing",
                  "parsing": "importing", "importing": "importing"}
STATUS_TEXT = {
    "queued": "Queued for processing...",
    "uploading": "Uploading file...",
    "parsing": "Parsing CSV file...",
    "importing": "Importing products...",
    "done": "Import completed successfully",
}
STATUS_TEXT_FAILED = "Import failed"
STATUS_TEXT_FAILED_WITH = "Import failed: %s"
STATUS_TEXT_OTHER = "Processing..."

# Python str.strip() whitespace: every code point with str.isspace(), 29 in all.
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
            "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
            "\u2028\u2029\u202f\u205f\u3000")
# The same set as one regex class usable by Java and RE2 (used by the SQL oracle).
WS_CLASS = (
    r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
STRIP_PATTERN = f"^{WS_CLASS}+|{WS_CLASS}+$"

# ---- schemas -------------------------------------------------------------------
CATALOG = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("sku", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("description", T.StringType(), True),
    T.StructField("active", T.BooleanType(), False),
    T.StructField("created_at", T.TimestampType(), False),
    T.StructField("updated_at", T.TimestampType(), False),
    T.StructField("sku_key", T.StringType(), False),
])

JOB_EVENT = T.StructType([
    T.StructField("job_id", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("processed_rows", T.LongType()),
    T.StructField("increment", T.LongType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("attempt", T.IntegerType()),
    T.StructField("at", T.TimestampType()),
])

PROGRESS_EVENT = T.StructType([
    T.StructField("job_id", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("stage", T.StringType()),
    T.StructField("processed_rows", T.LongType()),
    T.StructField("total_rows", T.LongType()),
    T.StructField("progress", T.DoubleType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("updated_at", T.TimestampType()),
])

SUBSCRIPTION = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("url", T.StringType()),
    T.StructField("events", T.ArrayType(T.StringType())),
    T.StructField("enabled", T.BooleanType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
])
