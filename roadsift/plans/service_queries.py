"""Queries of queues, upload ledgers and logs over the event and document tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger, logs
from ..streaming import work_queue
from .frames import table

#: Rules that the log query matches, in order; the first that fits a line holds.
RULES = [("[Cc]opyright", "rights reserved"), ("[Ll]icen[sc]e", "licence named"), ("@", "address found"), ("[0-9]{3,}", "number found")]


def queue_replay(spark, d):
    """The event stream as operations of a leased work queue a user, replayed in order."""
    return work_queue.replay(work_queue.operations(table(spark, d, "events"))).drop("at")


_OPS = """
ops AS (
  SELECT user_id AS queue, event_id AS number, epoch_us(ts) AS us, event_id % 3 AS worker,
         CASE event_type WHEN 'signup' THEN 'submit' WHEN 'purchase' THEN 'claim' WHEN 'click' THEN 'beat' WHEN 'view' THEN 'done' WHEN 'error' THEN 'fail' END AS op,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
  FROM events)
"""
_ITEM = "STRUCT(a BIGINT, w BIGINT, u BIGINT, k BIGINT)"
QUEUE_SQL = f"""
WITH RECURSIVE {_OPS},
-- s: items of a queue as (arrival, worker or null, lease's end, attempts), and counters
r(queue, n, number, op, item, s, done, failed) AS (
  SELECT queue, 0::BIGINT, 0::BIGINT, '', NULL::BIGINT, []::{_ITEM}[], 0::BIGINT, 0::BIGINT FROM ops GROUP BY queue
  UNION ALL
  SELECT queue, n, number, op, t,
         CASE op WHEN 'submit' THEN list_append(s, {{'a': number, 'w': NULL, 'u': NULL, 'k': 0}}::{_ITEM})
           WHEN 'claim' THEN list_transform(s, lambda x: CASE WHEN x.a = t THEN {{'a': x.a, 'w': worker, 'u': us + {work_queue.LEASE_US}, 'k': x.k + 1}}::{_ITEM} ELSE x END)
           WHEN 'beat' THEN list_transform(s, lambda x: CASE WHEN x.a = t THEN {{'a': x.a, 'w': x.w, 'u': us + {work_queue.LEASE_US}, 'k': x.k}}::{_ITEM} ELSE x END)
           WHEN 'done' THEN list_filter(s, lambda x: x.a IS DISTINCT FROM t)
           ELSE list_transform(list_filter(s, lambda x: x.a IS DISTINCT FROM t OR x.k < {work_queue.MOST_ATTEMPTS}), lambda x: CASE WHEN x.a = t THEN {{'a': x.a, 'w': NULL, 'u': NULL, 'k': x.k}}::{_ITEM} ELSE x END) END,
         done + (op = 'done' AND t IS NOT NULL)::BIGINT,
         failed + (op = 'fail' AND len(list_filter(s, lambda x: x.a = t AND x.k >= {work_queue.MOST_ATTEMPTS})) > 0)::BIGINT
  FROM (
    SELECT queue, n, number, op, us, worker, s, done, failed,
           CASE op WHEN 'submit' THEN number WHEN 'claim' THEN list_min(list_transform(list_filter(s, lambda x: x.w IS NULL), lambda x: x.a)) ELSE list_min(list_transform(list_filter(s, lambda x: x.w = worker), lambda x: x.a)) END AS t
    FROM (
      SELECT o.queue, o.n, o.number, o.op, o.us, o.worker, r.done,
             r.failed + len(list_filter(r.s, lambda x: coalesce(x.u < o.us, false) AND x.k >= {work_queue.MOST_ATTEMPTS})) AS failed,
             list_transform(list_filter(r.s, lambda x: NOT (coalesce(x.u < o.us, false) AND x.k >= {work_queue.MOST_ATTEMPTS})), lambda x: CASE WHEN coalesce(x.u < o.us, false) THEN {{'a': x.a, 'w': NULL, 'u': NULL, 'k': x.k}}::{_ITEM} ELSE x END) AS s
      FROM r JOIN ops o ON o.queue = r.queue AND o.n = r.n + 1)))
SELECT queue, number, op, item, len(list_filter(s, lambda x: x.w IS NULL))::BIGINT AS waiting, len(list_filter(s, lambda x: x.w IS NOT NULL))::BIGINT AS leased, done, failed FROM r WHERE n > 0
"""


def _chunks(spark, d):
    """Events as chunks of an upload a user and kind: offsets near the front are sent again and again."""
    e = table(spark, d, "events")
    return e.select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("upload"), "ts", "event_id", F.floor(F.col("value") * 7 % 9).cast("long").alias("offset"), (F.col("event_id") % 4).alias("length"))


_CHUNKS = "c AS (SELECT user_id || ':' || event_type AS upload, ts, event_id, floor((value * 7) % 9)::BIGINT AS offset_, event_id % 4 AS length FROM events)"


def upload_ledger(spark, d):
    """Chunks in order of arrival: appended only where the offset is what is there."""
    return ledger.accepted(_chunks(spark, d), "upload", ["ts", "event_id"], "offset", "length", most=2).select("event_id", "upload", "status", "size_after")


LEDGER_SQL = f"""
WITH RECURSIVE {_CHUNKS},
o AS (SELECT *, row_number() OVER (PARTITION BY upload ORDER BY ts, event_id) AS n FROM c),
r(upload, n, event_id, status, size_after) AS (
  SELECT upload, 0::BIGINT, 0::BIGINT, '', 0::BIGINT FROM o GROUP BY upload
  UNION ALL
  SELECT o.upload, o.n, o.event_id,
         CASE WHEN length <= 0 THEN 'invalid' WHEN length > 2 THEN 'too_large' WHEN offset_ = size_after THEN 'accepted' WHEN offset_ + length <= size_after THEN 'duplicate' ELSE 'conflict' END,
         size_after + CASE WHEN length > 0 AND length <= 2 AND offset_ = size_after THEN length ELSE 0 END
  FROM r JOIN o ON o.upload = r.upload AND o.n = r.n + 1)
SELECT event_id, upload, status, size_after FROM r WHERE n > 0
"""


def upload_coverage(spark, d):
    """Merged ranges of each upload against a size of ten bytes."""
    c = _chunks(spark, d)
    return ledger.coverage(c, c.select("upload").distinct().withColumn("total", F.lit(10).cast("long")), "upload", "offset", "length", "total")


COVERAGE_SQL = f"""
WITH {_CHUNKS},
b AS (SELECT DISTINCT upload, unnest(range(offset_, least(offset_ + length, 10))) AS p FROM c),
e AS (SELECT upload, p, coalesce(p - lag(p) OVER (PARTITION BY upload ORDER BY p), 2) > 1 AS new FROM b),
k AS (SELECT upload, count(*) AS covered, count(*) FILTER (new) AS parts FROM e GROUP BY 1),
m AS (SELECT u.upload, q.p FROM (SELECT DISTINCT upload FROM c) u, (SELECT unnest(range(0, 10)) AS p) q WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.upload = u.upload AND b.p = q.p)),
h AS (SELECT upload, count(*) FILTER (new) AS holes, min(p) AS f FROM (SELECT upload, p, coalesce(p - lag(p) OVER (PARTITION BY upload ORDER BY p), 2) > 1 AS new FROM m) GROUP BY 1)
SELECT u.upload, coalesce(covered, 0) AS covered, coalesce(parts, 0) AS parts, coalesce(holes, 0) AS holes, coalesce(f, 10) AS resume_at, coalesce(holes, 0) = 0 AS complete
FROM (SELECT DISTINCT upload FROM c) u LEFT JOIN k USING (upload) LEFT JOIN h USING (upload)
"""


def log_reasons(spark, d):
    """Documents read as logs: the newest of the last lines that a rule fits, else the masked last line."""
    lines = logs.lines_of(table(spark, d, "documents"), "doc_id", "text").withColumn("code", (F.col("doc_id") % 2).cast("int"))
    return logs.reasons(lines, "doc_id", RULES, "code")


_RULE_SQL = "CASE " + " ".join(f"WHEN regexp_matches(line, '{p}') THEN '{t}'" for p, t in RULES) + " END"
LOG_SQL = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
t AS (SELECT doc_id, pos, regexp_replace(line, '^[\s\x0B]+|[\s\x0B]+$', '', 'g') AS line FROM l),
n AS (SELECT *, {_RULE_SQL} AS rule FROM t WHERE line <> '' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos DESC) <= {logs.LAST}),
g AS (SELECT doc_id, arg_max(rule, pos) FILTER (rule IS NOT NULL) AS by_, arg_max(line, pos) AS line FROM n GROUP BY 1),
m AS (SELECT *, substr(regexp_replace(regexp_replace(line, '^skip:\s*', ''), '([A-Za-z]:)?[\\/][^\s\x0B]+', '…', 'g'), 1, {logs.SHOWN}) AS shown FROM g)
SELECT doc_id, coalesce(by_, CASE WHEN doc_id % 2 <> 0 THEN 'failed (code ' || (doc_id % 2) || '): ' || shown ELSE shown END) AS reason, by_ IS NOT NULL AS by_rule FROM m
"""

QUERIES = {
    "queue_replay": (queue_replay, QUEUE_SQL),
    "upload_ledger": (upload_ledger, LEDGER_SQL),
    "upload_coverage": (upload_coverage, COVERAGE_SQL),
    "log_reasons": (log_reasons, LOG_SQL),
}
