"""Queries of ledgers, metrics and traces."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomline.functions import expr
from loomline.operators import observe
from loomline.registry import query
from loomline.sources import tables
from loomline.sources.tables import LEDGER

_BOUNDS = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0]


def _ms():
    return F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)


_MS = "(epoch_us(ts) // 1000)"


@query("obs_ledger_filter", f"WITH {LEDGER} SELECT execution_id, entry_id, ts FROM ledger WHERE event_type = 'error' AND k BETWEEN 10 AND 60 AND ts >= TIMESTAMP '2024-01-05' ORDER BY execution_id, ts, entry_id LIMIT 200")
def ledger_filter(spark, sf_dir):
    """Filters that are given, in the ledger's order, a limited number of entries."""
    rows = observe.ledger_filter(tables.ledger(spark, sf_dir), {"event_type": "error", "props": " "}, {"k": (10, 60), "ts": (F.expr("timestamp_ntz '2024-01-05'"), None)})
    return rows.select("execution_id", "entry_id", "ts").orderBy("execution_id", "ts", "entry_id").limit(200)


@query("obs_ledger_sequence", f"WITH {LEDGER} SELECT entry_id, execution_id, row_number() OVER (PARTITION BY execution_id ORDER BY ts, entry_id) AS sequence FROM ledger")
def ledger_sequence(spark, sf_dir):
    return observe.sequenced(tables.ledger(spark, sf_dir)).select("entry_id", "execution_id", "sequence")


@query("obs_segments", f"""WITH {LEDGER}, p AS (SELECT entry_id, execution_id, {_MS} AS at_ms FROM ledger), e AS (SELECT *, coalesce(lead(at_ms) OVER (PARTITION BY execution_id ORDER BY at_ms, entry_id), at_ms + 1500) AS end_ms FROM p)
  SELECT entry_id, at_ms, end_ms, greatest(end_ms, at_ms + 1500) AS visual_end_ms FROM e""")
def segments(spark, sf_dir):
    points = tables.ledger(spark, sf_dir).select("execution_id", F.col("entry_id").alias("id"), _ms().alias("at_ms"))
    return observe.segments(points, "execution_id", 1500).select(F.col("id").alias("entry_id"), "at_ms", "end_ms", "visual_end_ms")


@query("obs_rates", f"""WITH {LEDGER}, s AS (SELECT execution_id, {_MS} AS at_ms, k // 10 AS completed FROM ledger), l AS (SELECT *, lag(at_ms) OVER w AS p_at, lag(completed) OVER w AS p_done FROM s WINDOW w AS (PARTITION BY execution_id ORDER BY at_ms, completed))
  SELECT execution_id, at_ms, completed, CASE WHEN at_ms > p_at THEN (completed - p_done) * 1000.0::DOUBLE / (at_ms - p_at) END AS rate FROM l WHERE p_done IS NULL OR completed <> p_done""")
def rates(spark, sf_dir):
    samples = tables.ledger(spark, sf_dir).select("execution_id", _ms().alias("at_ms"), F.floor(F.col("k") / 10).alias("completed"))
    return observe.rates(samples, "execution_id")


@query("obs_timeline", f"WITH {LEDGER} SELECT execution_id, count(*) AS events, min(ts) AS first_at, max(ts) AS last_at, string_agg(event_type, '>' ORDER BY ts, entry_id) AS path FROM ledger GROUP BY execution_id")
def timeline(spark, sf_dir):
    rows = F.transform(F.array_sort(F.collect_list(F.struct("ts", "entry_id", "event_type"))), lambda x: x["event_type"])
    return tables.ledger(spark, sf_dir).groupBy("execution_id").agg(F.count("*").alias("events"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.array_join(rows, ">").alias("path"))


_KINDS = ("click", "error", "purchase", "signup", "view")


@query("obs_counters", f"WITH {LEDGER} SELECT execution_id, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS n_{k}" for k in _KINDS) + " FROM ledger GROUP BY 1")
def counters(spark, sf_dir):
    """Counters by dimension."""
    return observe.counters(tables.ledger(spark, sf_dir), ["execution_id"], {f"n_{k}": F.col("event_type") == k for k in _KINDS})


@query("obs_policy_metrics", f"WITH {LEDGER} SELECT event_type, count(*) AS executions, count(*) FILTER (k < 80) AS successes, count(*) FILTER (k >= 80) AS failures, round(sum(value), 4) AS total_duration, arg_max(value, (ts, entry_id)) AS last_duration, max(ts) AS last_at FROM ledger GROUP BY 1")
def policy_metrics(spark, sf_dir):
    return tables.ledger(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("executions"), F.count_if(F.col("k") < 80).alias("successes"), F.count_if(F.col("k") >= 80).alias("failures"), F.round(F.sum("value"), 4).alias("total_duration"), F.max_by("value", F.struct("ts", "entry_id")).alias("last_duration"), F.max("ts").alias("last_at"))


@query("obs_storage_metrics", f"WITH {LEDGER} SELECT event_type, sum(k)::BIGINT AS bytes, count(*) FILTER (k % 2 = 0) AS hits, count(*) FILTER (k % 2 = 1) AS misses, sum(greatest(0, k - 50))::BIGINT AS removed FROM ledger GROUP BY 1")
def storage_metrics(spark, sf_dir):
    """Sums of bytes, hits and misses, and differences that count from 0."""
    return tables.ledger(spark, sf_dir).groupBy("event_type").agg(F.sum("k").alias("bytes"), F.count_if(F.col("k") % 2 == 0).alias("hits"), F.count_if(F.col("k") % 2 == 1).alias("misses"), F.sum(F.greatest(F.lit(0), F.col("k") - 50)).alias("removed"))


@query("obs_percentiles", f"WITH {LEDGER} SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, min(value) AS least, max(value) AS most FROM ledger GROUP BY 1")
def percentiles(spark, sf_dir):
    rows = tables.ledger(spark, sf_dir)
    both = observe.percentiles(rows, ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "least": 0.0, "most": 1.0})
    return both


@query("obs_histogram", f"WITH {LEDGER}, b AS (SELECT unnest(range(8))::INT AS bucket), c AS (SELECT (CASE " + " ".join(f"WHEN value <= {b} THEN {k}" for k, b in enumerate(_BOUNDS)) + " ELSE 7 END)::INT AS bucket, count(*) AS n FROM ledger GROUP BY 1) SELECT bucket, coalesce(n, 0) AS n FROM b LEFT JOIN c USING (bucket)")
def histogram(spark, sf_dir):
    return observe.histogram(tables.ledger(spark, sf_dir), "value", _BOUNDS)


@query("obs_rejection_rate", f"""WITH {LEDGER}, r AS (SELECT execution_id, count(*) FILTER (event_type = 'error') / greatest(1, count(*) FILTER (event_type = 'purchase'))::DOUBLE AS rate FROM ledger GROUP BY 1)
  SELECT execution_id, rate, rate > 0.2 AS flagged FROM r""")
def rejection_rate(spark, sf_dir):
    rate = F.count_if(F.col("event_type") == "error") / F.greatest(F.lit(1), F.count_if(F.col("event_type") == "purchase"))
    return tables.ledger(spark, sf_dir).groupBy("execution_id").agg(rate.alias("rate")).withColumn("flagged", F.col("rate") > 0.2)


@query("obs_last_samples", f"WITH {LEDGER} SELECT execution_id, entry_id FROM ledger QUALIFY row_number() OVER (PARTITION BY execution_id ORDER BY ts DESC, entry_id DESC) <= 4")
def last_samples(spark, sf_dir):
    return observe.last_n(tables.ledger(spark, sf_dir), ["execution_id"], 4, F.desc("ts"), F.desc("entry_id")).select("execution_id", "entry_id")


@query("obs_latest_event", f"WITH {LEDGER} SELECT execution_id, arg_max(event_type, (ts, entry_id)) AS event_type, max(ts) AS ts FROM ledger GROUP BY 1")
def latest_event(spark, sf_dir):
    """The last write of each key."""
    return observe.latest(tables.ledger(spark, sf_dir), ["execution_id"], F.desc("ts"), F.desc("entry_id")).select("execution_id", "event_type", "ts")


@query("obs_trace_lookup", f"WITH {LEDGER} SELECT entry_id FROM ledger WHERE entry_id = 42 OR execution_id = 42 OR k = 42")
def trace_lookup(spark, sf_dir):
    """An id in any of several columns."""
    return tables.ledger(spark, sf_dir).filter("entry_id = 42 or execution_id = 42 or k = 42").select("entry_id")


@query("obs_trace_key", f"WITH {LEDGER} SELECT entry_id, coalesce(nullif(trim(CASE WHEN k % 3 = 0 THEN ' ' WHEN k % 3 = 1 THEN 'run' END), ''), nullif(trim(event_type), '')) AS trace_key FROM ledger")
def trace_key(spark, sf_dir):
    rows = tables.ledger(spark, sf_dir).withColumn("run", F.when(F.col("k") % 3 == 0, " ").when(F.col("k") % 3 == 1, "run"))
    return rows.select("entry_id", expr.first_filled("run", "event_type").alias("trace_key"))


_ALIAS = {"view": "dag-store", "click": "dag-store", "error": "engine"}


@query("obs_trace_class", f"WITH {LEDGER} SELECT entry_id, CASE WHEN event_type IN ('view', 'click') THEN 'dag-store' WHEN event_type = 'error' THEN 'engine' ELSE event_type END AS component, event_type || CASE WHEN event_type = 'error' THEN '.failed' WHEN k >= 50 THEN '.succeeded' ELSE '.completed' END AS event_name FROM ledger")
def trace_class(spark, sf_dir):
    """Aliases of components, and event names by outcome."""
    alias = F.create_map(*(F.lit(x) for kv in _ALIAS.items() for x in kv))
    outcome = F.when(F.col("event_type") == "error", ".failed").when(F.col("k") >= 50, ".succeeded").otherwise(".completed")
    return tables.ledger(spark, sf_dir).select("entry_id", F.coalesce(F.element_at(alias, F.col("event_type")), F.col("event_type")).alias("component"), F.concat("event_type", outcome).alias("event_name"))


@query("obs_http_class", f"WITH {LEDGER} SELECT entry_id, CASE 400 + k % 30 WHEN 401 THEN 'unauthorized' WHEN 403 THEN 'forbidden' WHEN 429 THEN 'rejected' ELSE 'other' END AS class FROM ledger")
def http_class(spark, sf_dir):
    return tables.ledger(spark, sf_dir).select("entry_id", observe.http_class(400 + F.col("k") % 30).alias("class"))


@query("obs_http_errors", f"WITH {LEDGER} SELECT event_type, count(*) AS n, count(*) FILTER (350 + k >= 400 OR event_type = 'error') AS errors FROM ledger WHERE event_type <> 'signup' GROUP BY 1")
def http_errors(spark, sf_dir):
    """Entries of the chosen kinds, and those with a status from 400 on or an error."""
    rows = tables.ledger(spark, sf_dir).filter("event_type <> 'signup'")
    return observe.counters(rows, ["event_type"], {"n": F.lit(True), "errors": (350 + F.col("k") >= 400) | (F.col("event_type") == "error")})


@query("obs_enrichment", f"WITH {LEDGER} SELECT entry_id, coalesce(CASE WHEN k % 4 = 0 THEN 'own-' || k END, first_value(event_type) OVER (PARTITION BY execution_id ORDER BY ts, entry_id)) AS correlation FROM ledger")
def enrichment(spark, sf_dir):
    """An entry's own value, else the ambient one, here the execution's first event."""
    first = F.first("event_type").over(Window.partitionBy("execution_id").orderBy("ts", "entry_id"))
    return tables.ledger(spark, sf_dir).select("entry_id", F.coalesce(F.when(F.col("k") % 4 == 0, F.concat(F.lit("own-"), "k")), first).alias("correlation"))


@query("obs_find", "SELECT event_id, event_type, value FROM events WHERE event_type IN ('click', 'view') AND user_id = 8 ORDER BY value DESC, event_id DESC LIMIT 20")
def find(spark, sf_dir):
    """Equality and lists, an order, a limit."""
    rows = tables.table(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "view") & (F.col("user_id") == 8))
    return rows.orderBy(F.desc("value"), F.desc("event_id")).limit(20).select("event_id", "event_type", "value")


@query("obs_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicates(spark, sf_dir):
    """Keys that break a uniqueness guard."""
    return tables.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).filter("n > 1")


_OPS = f"""{LEDGER}, ops AS (SELECT *, ['stored', 'loaded', 'hit', 'miss', 'failed'][(k % 5)::INT + 1] AS op, CASE WHEN k % 7 <> 0 THEN k * 100 - 900 END AS bytes,
    CASE entry_id % 4 WHEN 0 THEN 'Timeout' WHEN 1 THEN ' ' WHEN 2 THEN 'Format' END AS exception, 1000 - k AS before, 950 - entry_id % 100 AS after FROM ledger)"""


def _operations(spark, sf_dir):
    op = F.array(*map(F.lit, ("stored", "loaded", "hit", "miss", "failed")))[(F.col("k") % 5).cast("int")]
    n = F.col("entry_id") % 4
    exception = F.when(n == 0, "Timeout").when(n == 1, " ").when(n == 2, "Format")
    return tables.ledger(spark, sf_dir).select("*", op.alias("op"), F.when(F.col("k") % 7 != 0, F.col("k") * 100 - 900).alias("bytes"), exception.alias("exception"), (1000 - F.col("k")).alias("before"), (950 - F.col("entry_id") % 100).alias("after"))


@query("obs_storage_operations", f"""WITH {_OPS} SELECT event_type, count(*) FILTER (op = 'stored') AS stored, count(*) FILTER (op = 'loaded') AS loaded, count(*) FILTER (op = 'hit') AS hits,
  count(*) FILTER (op = 'miss') AS misses, count(*) FILTER (op = 'failed') AS failures, coalesce(sum(bytes) FILTER (op = 'stored' AND bytes > 0), 0)::BIGINT AS bytes_stored FROM ops GROUP BY 1""")
def storage_operations(spark, sf_dir):
    """Operations by kind of storage, for which the kind of event stands."""
    return observe.storage_operations(_operations(spark, sf_dir), ["event_type"])


@query("obs_failures", f"WITH {_OPS} SELECT event_type, CASE WHEN trim(exception) <> '' THEN trim(exception) ELSE 'unknown' END AS exception, count(*) AS n FROM ops WHERE op = 'failed' GROUP BY ALL")
def failures(spark, sf_dir):
    """Failures by exception."""
    return observe.failures(_operations(spark, sf_dir), ["event_type"])


@query("obs_hot_states", f"WITH {_OPS} SELECT execution_id, count(*) AS samples, arg_max(after, (ts, entry_id)) AS last_size, sum(CASE WHEN before > after THEN before - after ELSE 0 END)::BIGINT AS removed FROM ops GROUP BY 1")
def hot_states(spark, sf_dir):
    """Sizes of hot states by execution."""
    rows = _operations(spark, sf_dir).select("execution_id", F.col("ts").alias("at"), F.col("entry_id").alias("id"), "before", "after")
    return observe.hot_states(rows, "execution_id")


@query("obs_retention_savings", f"""WITH {_OPS} SELECT op AS reason, count(*) AS passes, sum(before)::BIGINT AS bytes_before, coalesce(sum(bytes) FILTER (bytes > 0), 0)::BIGINT AS bytes_after,
  sum(CASE WHEN bytes IS NULL OR bytes < 0 THEN before WHEN bytes < before THEN before - bytes ELSE 0 END)::BIGINT AS bytes_saved FROM ops GROUP BY 1""")
def retention_savings(spark, sf_dir):
    """Passes of retention by reason, with bytes before, after and saved."""
    rows = _operations(spark, sf_dir).select(F.col("op").alias("reason"), "before", F.col("bytes").alias("after"))
    return observe.retention_savings(rows, ["reason"])
