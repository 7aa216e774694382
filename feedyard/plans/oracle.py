"""Plain-SQL twins of the adapters and queries (run by DuckDB as the oracle)."""
from __future__ import annotations

from feedyard import schemas as S
from feedyard.plans.adapters import CATALOG_EPOCH, FEED_BATCH, RUN_TS


def strip(x: str) -> str:
    return f"regexp_replace({x}, '{S.STRIP_PATTERN}', '', 'g')"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


FEED_RAW = f"""
feed_src AS (
  SELECT p_partkey AS p, CAST(p_partkey % 4 AS INTEGER) AS file_no, p_name, p_type, p_size,
         CASE p_partkey % 3 WHEN 0 THEN upper('Sku-' || CAST(p_partkey // 12 * 24 AS VARCHAR))
                            WHEN 1 THEN lower('Sku-' || CAST(p_partkey // 12 * 24 AS VARCHAR))
                            ELSE 'Sku-' || CAST(p_partkey // 12 * 24 AS VARCHAR) END AS cased
  FROM part),
feed_raw AS (
  SELECT p, file_no, CAST(file_no + 1 AS INTEGER) AS file_rank,
    row_number() OVER (PARTITION BY file_no ORDER BY p) AS ord,
    CASE WHEN p % 101 = 0 THEN '' WHEN p % 103 = 0 THEN '   '
         WHEN p % 5 = 0 THEN '  ' || cased || ' ' WHEN p % 5 = 1 THEN chr(9) || cased
         ELSE cased END AS sku_raw,
    CASE WHEN p % 97 = 0 THEN '' WHEN p % 89 = 0 THEN repeat('n', 300)
         WHEN p % 7 = 3 THEN ' ' || p_name || '  ' ELSE p_name END AS name_raw,
    CASE WHEN p % 6 = 0 THEN '' WHEN p % 13 = 0 THEN p_type || ', "special"' ELSE p_type END AS desc_raw,
    CASE p % 7 WHEN 0 THEN 'true' WHEN 1 THEN 'yes' WHEN 2 THEN '0' WHEN 3 THEN 'N'
               WHEN 4 THEN '' WHEN 5 THEN 'maybe' ELSE ' False ' END AS active_raw,
    CASE WHEN p % 53 = 0 THEN 2 WHEN p % 59 = 0 THEN 3
         WHEN file_no = 1 AND p % 61 = 1 THEN 6
         ELSE (CASE file_no WHEN 1 THEN 5 WHEN 3 THEN 3 ELSE 4 END) END AS n_fields,
    CASE file_no WHEN 2 THEN 2 ELSE 1 END AS sku_pos,
    CASE file_no WHEN 2 THEN 1 ELSE 2 END AS name_pos,
    3 AS desc_pos,
    CASE file_no WHEN 3 THEN 0 ELSE 4 END AS active_pos
  FROM feed_src),
feed_rows AS (
  SELECT p, file_rank, ord, n_fields,
    CASE WHEN sku_pos <= n_fields THEN NULLIF(sku_raw, '') END AS sku_v,
    sku_pos <= n_fields AS sku_present,
    CASE WHEN name_pos <= n_fields THEN NULLIF(name_raw, '') END AS name_v,
    name_pos <= n_fields AS name_present,
    CASE WHEN desc_pos <= n_fields THEN NULLIF(desc_raw, '') END AS description_v,
    desc_pos <= n_fields AS description_present,
    TRUE AS description_in_header,
    CASE WHEN active_pos > 0 AND active_pos <= n_fields THEN NULLIF(active_raw, '') END AS active_v,
    active_pos > 0 AND active_pos <= n_fields AS active_present,
    active_pos > 0 AS active_in_header
  FROM feed_raw),
feed_cls AS (
  SELECT *,
    sku_v IS NULL OR name_v IS NULL AS is_skip,
    description_in_header AND NOT description_present AS desc_missing,
    length({strip('sku_v')}) NOT BETWEEN {S.TEXT_MIN_LEN} AND {S.TEXT_MAX_LEN} AS sku_bad,
    length({strip('name_v')}) NOT BETWEEN {S.TEXT_MIN_LEN} AND {S.TEXT_MAX_LEN} AS name_bad
  FROM feed_rows),
feed_out AS (
  SELECT p, file_rank, ord,
    CASE WHEN is_skip THEN 'skipped' WHEN desc_missing OR sku_bad OR name_bad THEN 'rejected'
         ELSE 'accepted' END AS outcome,
    CASE WHEN is_skip THEN 'missing_sku_or_name' WHEN desc_missing THEN 'description_missing'
         WHEN sku_bad OR name_bad THEN concat_ws(',', CASE WHEN sku_bad THEN 'sku_length' END,
                                                    CASE WHEN name_bad THEN 'name_length' END)
         END AS reason,
    {strip('sku_v')} AS sku_s, {strip('name_v')} AS name_s,
    NULLIF({strip('description_v')}, '') AS desc_s,
    NOT coalesce(lower({strip('active_v')}) IN {S.FALSE_TOKENS}, FALSE) AS active_s,
    sku_v, name_v, description_v, active_v, sku_present, name_present, description_present,
    active_present, active_in_header
  FROM feed_cls),
feed_acc AS (
  SELECT file_rank, ord, sku_s AS sku, name_s AS name, desc_s AS description, active_s AS active,
         lower(sku_s) AS sku_key,
         row_number() OVER (PARTITION BY file_rank ORDER BY ord) AS acc_ord,
         CAST(ceil(row_number() OVER (PARTITION BY file_rank ORDER BY ord) / {FEED_BATCH}) AS BIGINT) AS batch
  FROM feed_out WHERE outcome = 'accepted')"""

CATALOG = f"""
catalog AS (
  SELECT p_partkey + 1 AS id, 'SKU-' || CAST(p_partkey AS VARCHAR) AS sku, p_name AS name,
         CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_type END AS description,
         p_size % 3 <> 0 AS active,
         make_timestamp(CAST(({CATALOG_EPOCH} + p_partkey // 4) * 1000000 AS BIGINT)) AS created_at,
         make_timestamp(CAST(({CATALOG_EPOCH} + p_partkey // 4) * 1000000 AS BIGINT)) AS updated_at,
         lower('SKU-' || CAST(p_partkey AS VARCHAR)) AS sku_key
  FROM part)"""

KEEP_LAST = """
keep_last AS (
  SELECT file_rank, batch, sku_key,
         arg_max({'sku': sku, 'name': name, 'description': description, 'active': active}, ord) AS last,
         min(ord) AS first_ord, max(ord) AS last_ord, count(*) AS n_rows
  FROM feed_acc GROUP BY file_rank, batch, sku_key)"""

PER_KEY = """
per_key AS (
  SELECT sku_key,
         arg_min(last.sku, file_rank * 1000000000000 + batch) AS first_spelling,
         arg_max(last, file_rank * 1000000000000 + last_ord) AS final,
         min(file_rank * 1000000000000 + first_ord) AS first_pos
  FROM keep_last GROUP BY sku_key)"""

UPSERT = f"""
joined AS (
  SELECT c.id, c.sku, c.name, c.description, c.active, c.created_at, c.updated_at,
         coalesce(c.sku_key, k.sku_key) AS sku_key, k.first_spelling, k.final, k.first_pos
  FROM catalog c FULL OUTER JOIN per_key k ON c.sku_key = k.sku_key),
upserted AS (
  SELECT id, sku,
         CASE WHEN first_pos IS NOT NULL THEN final.name ELSE name END AS name,
         CASE WHEN first_pos IS NOT NULL THEN final.description ELSE description END AS description,
         CASE WHEN first_pos IS NOT NULL THEN final.active ELSE active END AS active,
         created_at, updated_at, sku_key
  FROM joined WHERE id IS NOT NULL
  UNION ALL
  SELECT CAST((SELECT coalesce(max(id), 0) FROM catalog) + row_number() OVER (ORDER BY first_pos) AS BIGINT) AS id,
         first_spelling AS sku, final.name AS name, final.description AS description,
         final.active AS active, TIMESTAMP '{RUN_TS}' AS created_at, TIMESTAMP '{RUN_TS}' AS updated_at,
         sku_key
  FROM joined WHERE id IS NULL)"""


def validation(rows: str, max_errors: int) -> str:
    """The messages of the feed rows that `rows` chooses, cut at `max_errors` a file."""
    return f"""
head_msgs AS (
  SELECT file_rank, CAST(0 AS BIGINT) AS line, 0 AS seq,
         'Warning: Unknown headers will be ignored: price' AS message
  FROM (SELECT DISTINCT file_rank FROM feed_out) WHERE file_rank = 2),
samp AS (
  SELECT file_rank, ord, sku_v, name_v, sku_present, name_present,
         active_in_header AND (NOT active_present OR lower({strip("coalesce(active_v, '')")})
             NOT IN {S.TRUE_TOKENS + S.FALSE_TOKENS}) AS bad_active,
         CASE WHEN active_present THEN coalesce(active_v, '') ELSE 'None' END AS shown,
         CASE WHEN NOT sku_present THEN '{S.MSG_NOT_STRING}'
              WHEN length({strip("coalesce(sku_v, '')")}) < 1 THEN '{S.MSG_TOO_SHORT}'
              WHEN length({strip("coalesce(sku_v, '')")}) > 255 THEN '{S.MSG_TOO_LONG}' END AS sku_msg,
         CASE WHEN NOT name_present THEN '{S.MSG_NOT_STRING}'
              WHEN length({strip("coalesce(name_v, '')")}) < 1 THEN '{S.MSG_TOO_SHORT}'
              WHEN length({strip("coalesce(name_v, '')")}) > 255 THEN '{S.MSG_TOO_LONG}' END AS name_msg
  FROM feed_out WHERE {rows}),
samp_msgs AS (
  SELECT file_rank, ord, 1 AS seq,
         'Row ' || ord || ': Unexpected error - Cannot parse ''' || shown || ''' as boolean' AS message
  FROM samp WHERE bad_active
  UNION ALL
  SELECT file_rank, ord, 1, 'Row ' || ord || ', field ''sku'': ' || sku_msg
  FROM samp WHERE NOT bad_active AND sku_msg IS NOT NULL
  UNION ALL
  SELECT file_rank, ord, CASE WHEN sku_msg IS NULL THEN 1 ELSE 2 END,
         'Row ' || ord || ', field ''name'': ' || name_msg
  FROM samp WHERE NOT bad_active AND name_msg IS NOT NULL),
row_n AS (
  SELECT s.file_rank, s.ord,
         NOT s.bad_active AND (s.sku_msg IS NOT NULL OR s.name_msg IS NOT NULL) AS has_field_errors,
         (SELECT count(*) FROM samp_msgs m WHERE m.file_rank = s.file_rank AND m.ord <= s.ord) AS cum
  FROM samp s),
stops AS (
  SELECT file_rank, min(ord) AS stop_ord FROM row_n
  WHERE has_field_errors AND cum >= {max_errors} GROUP BY file_rank),
all_msgs AS (
  SELECT file_rank, line, seq, message FROM head_msgs
  UNION ALL
  SELECT m.file_rank, m.ord, m.seq, m.message FROM samp_msgs m LEFT JOIN stops s USING (file_rank)
  WHERE s.stop_ord IS NULL OR m.ord <= s.stop_ord
  UNION ALL
  SELECT file_rank, stop_ord, 99, '{S.MSG_STOPPED}' FROM stops)"""


VALIDATION = validation(f"ord <= {S.SAMPLE_SIZE}", S.MAX_SAMPLE_ERRORS)

CREATE_REQ = """
create_req AS (
  SELECT o_orderkey AS req_id,
         CASE WHEN o_orderkey % 211 = 0 THEN '   ' ELSE '  Sku-' || CAST(o_orderkey % 5000 AS VARCHAR) || ' ' END AS sku,
         'Order ' || CAST(o_orderkey AS VARCHAR) AS name, o_orderpriority AS description,
         o_orderstatus <> 'F' AS active
  FROM orders)"""

PATCH_REQ = """
patch_req AS (
  SELECT o_orderkey AS req_id, o_orderkey * 2 + 1 AS id,
         CASE o_orderkey % 4 WHEN 0 THEN ' sku-' || CAST(o_orderkey * 2 AS VARCHAR)
                             WHEN 1 THEN 'SKU-' || CAST(o_orderkey * 2 + 2 AS VARCHAR) END AS sku,
         CASE WHEN o_orderkey % 3 = 0 THEN 'Renamed ' || CAST(o_orderkey AS VARCHAR) END AS name,
         CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority END AS description,
         CASE o_orderstatus WHEN 'F' THEN FALSE WHEN 'O' THEN TRUE END AS active
  FROM orders
  UNION ALL
  SELECT o_orderkey + 10000000, o_orderkey * 2 + 1,
         CASE WHEN o_orderkey % 3 <> 1 THEN ' New-' || CAST(o_orderkey // 2 AS VARCHAR) || ' ' END,
         CASE WHEN o_orderkey % 2 = 0 THEN '  Renamed ' || CAST(o_orderkey AS VARCHAR) || ' ' END, NULL, NULL
  FROM orders
  UNION ALL
  SELECT o_orderkey + 20000000, o_orderkey * 2 + 1,
         CASE WHEN o_orderkey % 3 <> 1 THEN ' New-' || CAST(o_orderkey // 2 AS VARCHAR) || ' ' END,
         CASE WHEN o_orderkey % 7 = 0 THEN '   ' END, o_orderpriority, TRUE
  FROM orders WHERE o_orderkey % 2 = 0)"""

from feedyard.plans.adapters import ASOF, PROGRESS_TOTAL  # noqa: E402

JOBS = """
jobs AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS job_id, 'feed_' || CAST(o_orderkey AS VARCHAR) || '.csv' AS filename,
         CASE WHEN o_orderkey % 10 = 0 THEN 'bulk_delete' ELSE 'import' END AS job_type,
         CASE o_orderstatus WHEN 'O' THEN 'importing' WHEN 'P' THEN 'parsing' ELSE 'done' END AS status,
         CAST(floor(o_totalprice / 100) AS BIGINT) AS total_rows,
         CAST(CASE WHEN o_orderstatus NOT IN ('O', 'P') THEN floor(o_totalprice / 100) ELSE 0 END AS BIGINT)
           AS processed_rows,
         CAST(NULL AS VARCHAR) AS error_message, o_orderdate AS created_at, o_orderdate AS updated_at
  FROM orders)"""

JOB_EVENTS = """
job_events AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS job_id,
         {'line': CAST(0 AS BIGINT), 'part': CAST(0 AS BIGINT), 'supp': CAST(0 AS BIGINT),
          'qty': CAST(0 AS DOUBLE), 'price': CAST(0 AS DOUBLE)} AS seq, 'queued' AS status,
         CAST(0 AS BIGINT) AS processed_rows, CAST(NULL AS BIGINT) AS increment,
         CAST(NULL AS VARCHAR) AS error_message, o_orderdate AS "at"
  FROM orders
  UNION ALL
  SELECT CAST(l_orderkey AS VARCHAR), {'line': CAST(l_linenumber AS BIGINT), 'part': l_partkey,
         'supp': l_suppkey, 'qty': l_quantity, 'price': l_extendedprice},
         CASE WHEN l_linenumber % 2 = 0 THEN
           CASE WHEN l_returnflag = 'R' THEN 'failed' WHEN l_linestatus = 'F' THEN 'done' ELSE 'importing' END END,
         CASE WHEN l_linenumber % 2 = 0 AND l_linenumber % 4 = 0 THEN CAST(trunc(l_extendedprice) AS BIGINT) END,
         CASE WHEN l_linenumber % 2 = 1 THEN CAST(trunc(l_quantity) AS BIGINT) END,
         CASE WHEN l_linenumber % 2 = 0 AND l_returnflag = 'R' THEN 'ValueError: bad row ' || CAST(l_partkey AS VARCHAR) END,
         l_shipdate
  FROM lineitem)"""

PROGRESS_EVENTS = f"""
progress_events AS (
  SELECT CAST(user_id AS VARCHAR) AS job_id, event_id AS seq,
         CASE event_type WHEN 'click' THEN 'importing' WHEN 'view' THEN 'parsing' WHEN 'signup' THEN 'queued'
                         WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' END AS status,
         CASE WHEN event_id % 3 <> 0 THEN 'batch_' || CAST(event_id % 17 AS VARCHAR) END AS stage,
         CASE WHEN event_id % 4 <> 0 THEN event_id % 1000 END AS processed_rows,
         CAST({PROGRESS_TOTAL} AS BIGINT) AS total_rows,
         CASE WHEN event_id % 4 <> 0 THEN round_even(CAST(event_id % 1000 AS DOUBLE) / {PROGRESS_TOTAL} * 100, 2) END AS progress,
         CASE WHEN event_type = 'error' AND event_id % 5 <> 0 THEN 'RuntimeError: event ' || CAST(event_id AS VARCHAR) END
           AS error_message,
         ts AS updated_at
  FROM events)"""

# a job's updates since its last pause of an hour: what was stored before has expired
LIVE_RUN = """
{name} AS (
  SELECT e.* FROM {src} e JOIN (
    SELECT job_id, max(updated_at) AS run_start FROM (
      SELECT job_id, updated_at, lag(updated_at) OVER (PARTITION BY job_id ORDER BY updated_at, seq) AS prev FROM {src})
    WHERE prev IS NULL OR epoch_us(updated_at) - epoch_us(prev) >= 3600000000 GROUP BY job_id) r USING (job_id)
  WHERE e.updated_at >= r.run_start)"""

SNAPSHOT = f"""
upto AS (SELECT * FROM progress_events WHERE updated_at <= TIMESTAMP '{ASOF}'),
{LIVE_RUN.format(name="live_run", src="upto")},
snapshot AS (
  SELECT job_id,
         arg_max(status, CASE WHEN status IS NOT NULL THEN seq END) AS status,
         arg_max(stage, CASE WHEN stage IS NOT NULL THEN seq END) AS stage,
         arg_max(processed_rows, CASE WHEN processed_rows IS NOT NULL THEN seq END) AS processed_rows,
         arg_max(total_rows, CASE WHEN total_rows IS NOT NULL THEN seq END) AS total_rows,
         arg_max(progress, CASE WHEN progress IS NOT NULL THEN seq END) AS progress,
         arg_max(error_message, CASE WHEN error_message IS NOT NULL THEN seq END) AS error_message,
         max(updated_at) AS updated_at, max(seq) AS last_seq,
         max(updated_at) > TIMESTAMP '{ASOF}' - INTERVAL 3600 SECOND AS live
  FROM live_run GROUP BY job_id)"""

OR_DEFAULT = """
or_default AS (
  SELECT j.job_id,
         CASE WHEN s.last_seq IS NOT NULL THEN s.status ELSE j.status END AS status,
         CASE WHEN s.last_seq IS NOT NULL THEN s.stage ELSE 'queued' END AS stage,
         CASE WHEN s.last_seq IS NOT NULL THEN s.processed_rows ELSE j.processed_rows END AS processed_rows,
         CASE WHEN s.last_seq IS NOT NULL THEN s.total_rows ELSE j.total_rows END AS total_rows,
         CASE WHEN s.last_seq IS NOT NULL THEN s.progress ELSE 0.0 END AS progress_percent,
         s.last_seq IS NOT NULL AS from_snapshot
  FROM jobs j LEFT JOIN snapshot s ON j.job_id = s.job_id AND s.live)"""

ET_LIST = "[" + ", ".join(f"'{t}'" for t in S.EVENT_TYPES) + "]"

SUBS = f"""
subs AS (
  SELECT s_suppkey AS id,
         CASE s_suppkey % 9 WHEN 0 THEN 'ftp://hooks.example/' || CAST(s_suppkey AS VARCHAR)
                           WHEN 1 THEN '  https://hooks.example/' || CAST(s_suppkey AS VARCHAR) || ' '
                           ELSE 'https://hooks.example/s/' || CAST(s_suppkey AS VARCHAR) END AS url,
         CASE s_suppkey % 6
           WHEN 0 THEN CAST([] AS VARCHAR[])
           WHEN 1 THEN [{ET_LIST}[(s_suppkey // 6) % 6 + 1]]
           WHEN 2 THEN [{ET_LIST}[(s_suppkey // 6) % 6 + 1], {ET_LIST}[((s_suppkey // 6) % 6 + 1) % 6 + 1]]
           WHEN 3 THEN [{ET_LIST}[(s_suppkey // 6) % 6 + 1], {ET_LIST}[((s_suppkey // 6) % 6 + 2) % 6 + 1],
                        {ET_LIST}[(s_suppkey // 6) % 6 + 1]]
           WHEN 4 THEN [{ET_LIST}[(s_suppkey // 6) % 6 + 1], {ET_LIST}[((s_suppkey // 6) % 6 + 3) % 6 + 1]]
           ELSE [{ET_LIST}[((s_suppkey // 6) % 6 + 4) % 6 + 1]] END AS events,
         s_suppkey % 4 <> 0 AS enabled,
         make_timestamp(CAST(({CATALOG_EPOCH} + s_suppkey * 3600) * 1000000 AS BIGINT)) AS created_at
  FROM supplier),
vsubs AS (SELECT * FROM subs WHERE (starts_with(url, 'http://') OR starts_with(url, 'https://')) AND len(events) > 0),
receivers AS (SELECT DISTINCT id AS webhook_id, unnest(events) AS event_type FROM vsubs WHERE enabled)"""

# JSON as the deliveries send it: NULL fields stay, times are ISO text
PAYLOAD = """CASE WHEN event_type IN ('product.created', 'product.updated', 'product.deleted') THEN
    CAST(json_object('id', p_id, 'sku', p_sku, 'name', p_name, 'description', p_description, 'active', p_active,
         'created_at', strftime(p_created_at, '%Y-%m-%dT%H:%M:%S'), 'updated_at', strftime(p_updated_at, '%Y-%m-%dT%H:%M:%S')) AS VARCHAR)
  WHEN event_type = 'product.bulk_deleted' THEN
    CAST(json_object('job_id', job_id, 'status', 'done', 'deleted_count', count, 'total_products', total) AS VARCHAR)
  WHEN event_type = 'import.completed' THEN
    CAST(json_object('job_id', job_id, 'status', 'done', 'processed_rows', count, 'total_rows', total) AS VARCHAR)
  ELSE CAST(json_object('job_id', job_id, 'status', 'failed', 'error_message', error_message, 'processed_rows', count) AS VARCHAR)
  END"""

CHANGES = f"""
changes AS (
  SELECT e.event_id, e.event_type, e.ts, e.value, e.user_id,
         c.id AS p_id, c.sku AS p_sku, c.name AS p_name, c.description AS p_description, c.active AS p_active,
         c.created_at AS p_created_at, c.updated_at AS p_updated_at,
         'job-' || CAST(e.user_id AS VARCHAR) AS job_id, e.event_id % 1000 AS count, CAST(1000 AS BIGINT) AS total,
         CASE WHEN e.event_type = 'import.failed' THEN 'RuntimeError: event ' || CAST(e.event_id AS VARCHAR) END
           AS error_message
  FROM (SELECT event_id, ts, value, user_id,
               CASE WHEN event_id % 50 = 0 THEN 'product.bulk_deleted'
                    WHEN event_type = 'view' THEN 'product.created' WHEN event_type = 'click' THEN 'product.updated'
                    WHEN event_type = 'purchase' THEN 'product.deleted' WHEN event_type = 'signup' THEN 'import.completed'
                    ELSE 'import.failed' END AS event_type
        FROM events) e
  LEFT JOIN catalog c ON c.id = e.user_id * 2 + 1 AND starts_with(e.event_type, 'product.')
                      AND e.event_type <> 'product.bulk_deleted')"""

DELIVERIES = f"""
pairs AS (SELECT c.event_id, c.event_type, c.ts, c.value, r.webhook_id, {PAYLOAD} AS payload FROM changes c JOIN receivers r USING (event_type)),
classified AS (
  SELECT p.*, CASE WHEN v.id IS NULL OR v.id % 7 = 3 THEN 'missing'
                   WHEN NOT (v.enabled AND v.id % 5 <> 2) THEN 'disabled' ELSE 'deliver' END AS action
  FROM pairs p LEFT JOIN vsubs v ON v.id = p.webhook_id),
dlv AS (
  SELECT event_id * 100000 + webhook_id AS id, webhook_id, event_type, event_id, payload,
         CASE WHEN event_id % 11 <> 0 THEN CAST(200 + 100 * (event_id % 4) AS INTEGER) END AS response_code,
         CASE WHEN event_id % 11 = 0 THEN 'timed out ' || repeat('.', CAST(event_id % 1200 AS INTEGER))
              ELSE coalesce(d.text, 'ok') END AS raw_body,
         value / 100.0 AS elapsed_s, ts AS attempted_at,
         CASE WHEN (event_id + webhook_id) % 13 = 0 THEN event_id % 6 ELSE 0 END AS internal_failures
  FROM classified LEFT JOIN documents d ON d.doc_id = event_id WHERE action = 'deliver'),
dlog AS (
  SELECT id, webhook_id, event_type, event_id, payload,
         CASE WHEN response_code BETWEEN 200 AND 299 THEN 'success' ELSE 'failed' END AS status,
         response_code,
         CASE WHEN response_code IS NULL THEN left(raw_body, 1000)
              WHEN length(raw_body) > 1000 THEN left(raw_body, 1000) || '... (truncated)' ELSE raw_body END
           AS response_body,
         CAST(trunc(elapsed_s * 1000) AS INTEGER) AS response_time_ms, attempted_at,
         attempted_at + to_milliseconds(CAST(trunc(elapsed_s * 1000) AS INTEGER)) AS completed_at,
         internal_failures
  FROM dlv)"""

SUB_CREATE_REQ = f"""
sub_create_req AS (
  SELECT c_custkey AS req_id,
         CASE c_custkey % 5 WHEN 0 THEN 'ftp://c.example/' || CAST(c_custkey AS VARCHAR)
                            WHEN 1 THEN ' https://c.example/' || CAST(c_custkey AS VARCHAR) || ' '
                            ELSE 'https://c.example/' || CAST(c_custkey AS VARCHAR) END AS url,
         CASE c_custkey % 4 WHEN 0 THEN CAST([] AS VARCHAR[])
                            WHEN 1 THEN [{ET_LIST}[c_nationkey % 6 + 1]]
                            ELSE [{ET_LIST}[c_nationkey % 6 + 1], {ET_LIST}[(c_nationkey + 1) % 6 + 1]] END AS events,
         c_custkey % 3 <> 0 AS enabled
  FROM customer)"""

SUB_PATCH_REQ = f"""
sub_patch_req AS (
  SELECT c_custkey AS req_id, c_custkey % 200 AS id,
         CASE c_custkey % 4 WHEN 0 THEN 'https://p.example/' || CAST(c_custkey AS VARCHAR)
                            WHEN 1 THEN 'gopher://x' END AS url,
         CASE c_custkey % 5 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN [{ET_LIST}[c_custkey % 6 + 1]] END AS events,
         CASE c_custkey % 3 WHEN 0 THEN FALSE WHEN 1 THEN TRUE END AS enabled
  FROM customer)"""
