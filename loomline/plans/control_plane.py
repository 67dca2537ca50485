"""Queries of the control plane: admission, queues, registries, permissions, and folds of event logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomline.operators import control
from loomline.registry import query
from loomline.sources import tables
from loomline.sources.tables import LEDGER

_RUN_STATES = ("Pending", "Running", "Completed", "Failed", "Cancelled", "Queued")
_STATES = ("Ready", "Busy", "Paused", "Draining", "Unhealthy", "Stopped", "Ready")


def _nth(names, n):
    return F.element_at(F.array(*map(F.lit, names)), (n + 1).cast("int"))


def _list(names):
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


_INSTANCES = f"""instances AS (SELECT s_suppkey AS instance_id, s_nationkey AS region, {_list(_STATES)}[(s_nationkey % 7)::INT + 1] AS status,
    count(l_orderkey) FILTER (l_linestatus = 'O') AS running, count(l_orderkey) FILTER (l_returnflag = 'R') AS queued FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY ALL)"""


def _instances(spark, sf_dir):
    load = tables.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count_if(F.col("l_linestatus") == "O").alias("running"), F.count_if(F.col("l_returnflag") == "R").alias("queued"))
    rows = tables.table(spark, sf_dir, "supplier").join(load, "s_suppkey", "left")
    return rows.select(F.col("s_suppkey").alias("instance_id"), F.col("s_nationkey").alias("region"), _nth(_STATES, F.col("s_nationkey") % 7).alias("status"), F.coalesce("running", F.lit(0)).alias("running"), F.coalesce("queued", F.lit(0)).alias("queued"))


@query("control_eligible", f"WITH {_INSTANCES} SELECT instance_id, status FROM instances WHERE status NOT IN ('Stopped', 'Paused', 'Unhealthy')")
def eligible(spark, sf_dir):
    return control.eligible_instances(_instances(spark, sf_dir), draining=True).select("instance_id", "status")


@query("control_least_loaded", f"WITH {_INSTANCES} SELECT region % 5 AS zone, arg_min(instance_id, (CASE WHEN instance_id % 50 = 7 THEN 0 ELSE 1 END, running, queued, instance_id)) AS instance_id FROM instances WHERE status NOT IN ('Stopped', 'Paused', 'Draining', 'Unhealthy') GROUP BY 1")
def least_loaded(spark, sf_dir):
    rows = control.eligible_instances(_instances(spark, sf_dir)).withColumn("zone", F.col("region") % 5)
    return control.least_loaded(rows, ["zone"], F.col("instance_id") % 50 == 7).select("zone", "instance_id")


_RUNS = f"""runs AS (SELECT o_orderkey AS item_id, o_custkey AS tenant, {_list(_RUN_STATES)}[(o_orderkey % 6)::INT + 1] AS status, left(o_orderpriority, 1)::INT AS priority, o_orderdate AS enqueued_at FROM orders)"""


def _runs(spark, sf_dir):
    return tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("tenant"), _nth(_RUN_STATES, F.col("o_orderkey") % 6).alias("status"), F.left("o_orderpriority", F.lit(1)).cast("int").alias("priority"), F.col("o_orderdate").alias("enqueued_at"))


@query("control_run_list", f"WITH {_RUNS} SELECT item_id, tenant, status FROM runs WHERE status NOT IN ('Cancelled', 'Completed', 'Failed')")
def run_list(spark, sf_dir):
    return _runs(spark, sf_dir).filter(~F.col("status").isin(*control.ENDED)).select("item_id", "tenant", "status")


@query("control_queue_order", f"WITH {_RUNS} SELECT tenant, item_id, row_number() OVER (PARTITION BY tenant ORDER BY priority, enqueued_at, item_id)::INT AS place FROM runs WHERE status = 'Pending'")
def queue_order(spark, sf_dir):
    return control.queue_order(_runs(spark, sf_dir), ["tenant"]).select("tenant", "item_id", "place")


@query("control_queue_score", f"WITH {_RUNS} SELECT item_id, priority * 1e12::DOUBLE + epoch_ms(enqueued_at) AS score FROM runs")
def queue_score(spark, sf_dir):
    return _runs(spark, sf_dir).select("item_id", control.queue_score(F.col("priority"), F.unix_millis(F.col("enqueued_at").cast("timestamp"))).alias("score"))



@query("control_queue_enqueue", "SELECT user_id AS item_id, min(ts) AS enqueued_at, count(*) - 1 AS refused FROM events WHERE event_type = 'view' GROUP BY 1")
def queue_enqueue(spark, sf_dir):
    """The first creation of a key holds, later ones are refused."""
    rows = tables.table(spark, sf_dir, "events").filter("event_type = 'view'")
    return rows.groupBy(F.col("user_id").alias("item_id")).agg(F.min("ts").alias("enqueued_at"), (F.count("*") - 1).alias("refused"))


@query("control_finalise", """SELECT user_id AS run_id, arg_min(CASE event_type WHEN 'error' THEN 'Failed' WHEN 'purchase' THEN 'Completed' ELSE 'Cancelled' END, (ts, event_id)) AS status, min(ts) AS at, count(*) - 1 AS refused FROM events WHERE event_type IN ('error', 'purchase', 'signup') GROUP BY 1""")
def finalise(spark, sf_dir):
    """The first terminal event of a run, and how many came too late."""
    status = F.when(F.col("event_type") == "error", "Failed").when(F.col("event_type") == "purchase", "Completed").when(F.col("event_type") == "signup", "Cancelled").otherwise("Running")
    rows = tables.table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), "event_id", F.col("ts").alias("at"), status.alias("status"))
    return control.first_terminal(rows, "run_id")


@query("control_gate", f"WITH {_RUNS} SELECT item_id, CASE priority WHEN 1 THEN 'Cancel' WHEN 2 THEN 'StopClaiming' WHEN 3 THEN 'StopClaiming' ELSE 'Continue' END AS decision FROM runs")
def gate(spark, sf_dir):
    """What the state of control says to a worker."""
    state = F.element_at(F.array(*map(F.lit, ["Cancelling", "Paused", "WaitingForInput", "Resuming", "Running"])), F.col("priority"))
    return _runs(spark, sf_dir).select("item_id", control.control_gate(state).alias("decision"))


@query("control_cleanup", f"WITH {_RUNS} SELECT status, status = 'Completed' AS cleaned, count(*) AS n FROM runs GROUP BY ALL")
def cleanup(spark, sf_dir):
    return _runs(spark, sf_dir).groupBy("status", control.may_cleanup(F.col("status")).alias("cleaned")).agg(F.count("*").alias("n"))


@query("control_restore_compatible", f"WITH {_RUNS} SELECT item_id, (CASE WHEN item_id % 4 = 0 THEN NULL ELSE status END) IS NOT DISTINCT FROM (CASE WHEN item_id % 8 = 0 THEN NULL ELSE status END) AND priority IS NOT DISTINCT FROM (item_id % 5 + 1) AS compatible FROM runs")
def restore_compatible(spark, sf_dir):
    key = F.col("item_id")
    a, b = F.when(key % 4 != 0, F.col("status")), F.when(key % 8 != 0, F.col("status"))
    return _runs(spark, sf_dir).select("item_id", (a.eqNullSafe(b) & F.col("priority").eqNullSafe(key % 5 + 1)).alias("compatible"))


_GRANTS = """g(trn) AS (VALUES ('trn:p1:building:orders:list:read'), ('trn:p1:machinery:orders:list:*'), ('trn:p2:building:orders:*:*'), ('TRN:p2:household:*:*:read'), ('trn:p3:furniture:*:*:*'), ('trn:p1:automobile:ord*:list:read'), ('bad:p1:building:orders:list:write'), ('trn:p4:x'))"""


@query("control_permissions", f"""WITH {_GRANTS}, k AS (SELECT DISTINCT string_split(lower(trim(trn)), ':') AS p FROM g WHERE len(string_split(trn, ':')) = 6 AND lower(trim(trn)) LIKE 'trn:%'),
  r AS (SELECT c_custkey AS request_id, 'p' || (c_custkey % 4) AS project, lower(c_mktsegment) AS ns, 'orders' AS resource, 'list' AS feature, CASE WHEN c_nationkey % 2 = 0 THEN 'read' ELSE 'write' END AS action FROM customer)
  SELECT request_id, EXISTS (SELECT 1 FROM k WHERE p[2] = project AND p[3] = ns AND (p[4] = resource AND p[5] = feature AND p[6] IN (action, '*') OR p[4] = resource AND p[5] = '*' AND p[6] IN (action, '*') OR p[4] = '*' AND p[5] = '*' AND p[6] IN (action, '*'))) AS allowed FROM r""")
def permissions(spark, sf_dir):
    return control.granted(*_permission_tables(spark, sf_dir)).select("request_id", "allowed")


def _permission_tables(spark, sf_dir):
    grants = spark.createDataFrame([(t,) for t in ("trn:p1:building:orders:list:read", "trn:p1:machinery:orders:list:*", "trn:p2:building:orders:*:*", "TRN:p2:household:*:*:read", "trn:p3:furniture:*:*:*", "trn:p1:automobile:ord*:list:read", "bad:p1:building:orders:list:write", "trn:p4:x")], "trn string")
    c = tables.table(spark, sf_dir, "customer")
    requests = c.select(F.col("c_custkey").alias("request_id"), F.concat(F.lit("p"), F.col("c_custkey") % 4).alias("project"), F.col("c_mktsegment").alias("ns"), F.lit("orders").alias("resource"), F.lit("list").alias("feature"), F.when(F.col("c_nationkey") % 2 == 0, "read").otherwise("write").alias("action"))
    return grants, requests


_COARSE = {"resource": "p[5] = '*' AND p[6] = '*' AND p[4] IN (resource, '*')", "feature": "p[6] = '*' AND (p[4] = resource AND p[5] IN (feature, '*') OR p[4] = '*' AND p[5] = '*')", "any_action": "p[4] = '*' AND p[5] = '*' AND p[6] IN (action, '*')"}


@query("control_coarse_permissions", f"""WITH {_GRANTS}, k AS (SELECT DISTINCT string_split(lower(trim(trn)), ':') AS p FROM g WHERE len(string_split(trn, ':')) = 6 AND lower(trim(trn)) LIKE 'trn:%'),
  r AS (SELECT c_custkey AS request_id, 'p' || (c_custkey % 4) AS project, lower(c_mktsegment) AS ns, 'orders' AS resource, 'list' AS feature, CASE WHEN c_nationkey % 2 = 0 THEN 'read' ELSE 'write' END AS action FROM customer)
  """ + " UNION ALL ".join(f"SELECT request_id, '{c}' AS check_level, EXISTS (SELECT 1 FROM k WHERE p[2] = project AND p[3] = ns AND ({on})) AS allowed FROM r" for c, on in _COARSE.items()))
def coarse_permissions(spark, sf_dir):
    """resource level, feature level, and an action on everything."""
    grants, requests = _permission_tables(spark, sf_dir)
    each = [control.granted(grants, requests, check).select("request_id", F.lit(check).alias("check_level"), "allowed") for check in _COARSE]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query("control_assistance", f"""WITH {_INSTANCES} SELECT instance_id, CASE WHEN status NOT IN ('Ready', 'Busy') THEN 'not_idle' WHEN queued > 220 THEN 'queue_depth' WHEN 640 - running - queued <= 0 THEN 'no_slots' ELSE 'granted' END AS decision,
  CASE WHEN status IN ('Ready', 'Busy') AND queued <= 220 AND 640 - running - queued > 0 THEN least(8, 640 - running - queued, 20 - region % 19) END AS workers FROM instances""")
def assistance(spark, sf_dir):
    """guards in order, then the smallest of the budgets."""
    slots = 640 - F.col("running") - F.col("queued")
    decision = F.when(~F.col("status").isin("Ready", "Busy"), "not_idle").when(F.col("queued") > 220, "queue_depth").when(slots <= 0, "no_slots").otherwise("granted")
    return _instances(spark, sf_dir).select("instance_id", decision.alias("decision"), F.when(decision == "granted", F.least(F.lit(8), slots, 20 - F.col("region") % 19)).alias("workers"))


@query("control_active_leases", """SELECT l_orderkey AS execution_id, sum(l_quantity)::BIGINT AS workers, count(DISTINCT l_suppkey) AS helpers FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1""")
def active_leases(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "lineitem").filter("l_linestatus = 'O'")
    return rows.groupBy(F.col("l_orderkey").alias("execution_id")).agg(F.sum("l_quantity").cast("long").alias("workers"), F.count_distinct("l_suppkey").alias("helpers"))


@query("control_helper_match", """WITH cand AS (SELECT DISTINCT l_orderkey AS execution_id, l_suppkey % 20 AS zone FROM lineitem WHERE l_returnflag = 'A'), held AS (SELECT DISTINCT l_orderkey AS execution_id, l_suppkey AS helper FROM lineitem WHERE l_linestatus = 'O'),
  m AS (SELECT s_suppkey AS helper, execution_id FROM cand JOIN supplier ON s_suppkey % 20 = zone AND s_nationkey < 3 ANTI JOIN held ON held.execution_id = cand.execution_id AND held.helper = supplier.s_suppkey)
  SELECT helper, execution_id FROM m QUALIFY row_number() OVER (PARTITION BY helper ORDER BY execution_id) <= 3""")
def helper_match(spark, sf_dir):
    """Candidates in order for each helper, without those that it holds a lease of, up to its most grants."""
    items = tables.table(spark, sf_dir, "lineitem")
    candidates = items.filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("execution_id"), (F.col("l_suppkey") % 20).alias("zone"))
    held = items.filter("l_linestatus = 'O'").select(F.col("l_orderkey").alias("execution_id"), F.col("l_suppkey").alias("helper"))
    helpers = tables.table(spark, sf_dir, "supplier").filter("s_nationkey < 3").select(F.col("s_suppkey").alias("helper"), (F.col("s_suppkey") % 20).alias("zone"))
    return control.first_unheld(candidates, helpers, held, 3)


@query("control_pump_counters", """SELECT user_id AS pump, count(*) AS attempted, count(*) FILTER (event_type = 'purchase') AS succeeded, count(*) FILTER (event_type = 'error') AS failed, string_agg(DISTINCT CASE WHEN event_type = 'error' THEN props END, ';' ORDER BY CASE WHEN event_type = 'error' THEN props END) AS reasons FROM events GROUP BY 1""")
def pump_counters(spark, sf_dir):
    error = F.col("event_type") == "error"
    reasons = F.array_join(F.array_sort(F.collect_set(F.when(error, F.col("props")))), ";")
    return tables.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("pump")).agg(F.count("*").alias("attempted"), F.count_if(F.col("event_type") == "purchase").alias("succeeded"), F.count_if(error).alias("failed"), F.nullif(reasons, F.lit("")).alias("reasons"))


@query("control_context_overlap", """SELECT conv_id, turn, greatest(length(text) % 100, CASE WHEN sum(CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN -1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) > 0 THEN 60 ELSE 0 END)::INT AS overlap FROM conversations""")
def context_overlap(spark, sf_dir):
    """A running count of what is in flight, and an overlap that is longer while anything is."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    flight = F.sum(F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", -1).otherwise(0)).over(w)
    return tables.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.greatest(F.length("text") % 100, F.when(flight > 0, 60).otherwise(0)).alias("overlap"))


@query("control_connections", "SELECT n_nationkey, c_custkey FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey = 2")
def connections(spark, sf_dir):
    """Connections of a group's members; members without any are dropped."""
    members = tables.table(spark, sf_dir, "nation").filter("n_regionkey = 2")
    customers = tables.table(spark, sf_dir, "customer")
    return members.join(customers, members["n_nationkey"] == customers["c_nationkey"]).select("n_nationkey", "c_custkey")


_CONTROL = ("pause", "mark_paused", "resume", "wait", "input", "mark_running")


@query("control_states", f"""WITH RECURSIVE {LEDGER}, ev AS (SELECT execution_id, row_number() OVER (PARTITION BY execution_id ORDER BY ts, entry_id) AS n, 'key-' || entry_id % 3 AS key,
    CASE k WHEN 98 THEN 'cancel' WHEN 99 THEN 'mark_cancelled' ELSE {_list(_CONTROL)}[(k % 6)::INT + 1] END AS action FROM ledger),
  walk AS (SELECT DISTINCT execution_id, 0::BIGINT AS n, 'Running' AS was, 'Running' AS status, NULL::VARCHAR AS waiting, 0::BIGINT AS changes, 0::BIGINT AS errors FROM ev
    UNION ALL SELECT execution_id, n, status, next, CASE WHEN action = 'wait' AND status NOT LIKE 'Cancel%' THEN key ELSE waiting END, changes + (next <> status)::BIGINT,
      errors + (action = 'input' AND status NOT LIKE 'Cancel%' AND waiting IS DISTINCT FROM key)::BIGINT FROM (
      SELECT w.execution_id, e.n, w.status, w.waiting, w.changes, w.errors, e.action, e.key, CASE
        WHEN w.status = 'Cancelled' OR e.action = 'mark_cancelled' THEN 'Cancelled' WHEN w.status = 'Cancelling' OR e.action = 'cancel' THEN 'Cancelling'
        WHEN e.action = 'pause' AND w.status <> 'Paused' THEN 'Pausing' WHEN e.action = 'mark_paused' AND w.status = 'Pausing' THEN 'Paused'
        WHEN e.action = 'resume' OR e.action = 'input' AND w.waiting = e.key THEN 'Resuming' WHEN e.action = 'wait' THEN 'WaitingForInput'
        WHEN e.action = 'mark_running' AND w.status = 'Resuming' THEN 'Running' ELSE w.status END AS next
      FROM walk w JOIN ev e ON e.execution_id = w.execution_id AND e.n = w.n + 1) s)
  SELECT execution_id, status, CASE WHEN status LIKE 'Cancel%' THEN 'Cancel' WHEN status IN ('Paused', 'Pausing', 'WaitingForInput') THEN 'StopClaiming' ELSE 'Continue' END AS decision, changes, errors
  FROM walk QUALIFY row_number() OVER (PARTITION BY execution_id ORDER BY n DESC) = 1""")
def control_states(spark, sf_dir):
    """The state of control that each execution's log leads to, and what it says to a worker."""
    k = F.col("k")
    action = F.when(k == 98, "cancel").when(k == 99, "mark_cancelled").otherwise(_nth(_CONTROL, k % 6))
    events = tables.ledger(spark, sf_dir).select("execution_id", F.col("ts").alias("at"), F.col("entry_id").alias("event_id"), action.alias("action"), F.concat(F.lit("key-"), F.col("entry_id") % 3).alias("input_key"))
    return control.control_states(events, "execution_id").withColumn("decision", control.control_gate(F.col("status")))


_RUN_EVENTS = ("create", "dispatch", "create", "dispatch", "create", "cancel", "complete", "dispatch", "fail")


@query("control_run_store", f"""WITH {LEDGER}, ev AS (SELECT execution_id || '/' || strftime(ts, '%Y-%m-%d') AS run_id, ts, entry_id, {_list(_RUN_EVENTS)}[(k % 9)::INT + 1] AS move FROM ledger),
  born AS (SELECT *, min((ts, entry_id)) FILTER (move = 'create') OVER (PARTITION BY run_id) AS b FROM ev),
  dead AS (SELECT *, min((ts, entry_id)) FILTER (move NOT IN ('create', 'dispatch') AND (ts, entry_id) > b) OVER (PARTITION BY run_id) AS d FROM born),
  live AS (SELECT *, b IS NOT NULL AND (ts, entry_id) >= b AND (d IS NULL OR (ts, entry_id) <= d) AS alive, (ts, entry_id) = b AS birth, coalesce((ts, entry_id) = d, false) AS death FROM dead)
  SELECT run_id, CASE WHEN count(b) = 0 THEN 'missing' WHEN count(d) > 0 THEN CASE max(move) FILTER (death) WHEN 'cancel' THEN 'Cancelled' WHEN 'complete' THEN 'Completed' ELSE 'Failed' END
      WHEN count(*) FILTER (alive AND move = 'dispatch') > 0 THEN 'Dispatched' ELSE 'Pending' END AS status,
    (count(*) FILTER (birth) + count(*) FILTER (death) + least(1, count(*) FILTER (alive AND move = 'dispatch')))::BIGINT AS changes,
    count(*) FILTER (NOT coalesce(birth OR death OR alive AND move = 'dispatch', false)) AS errors FROM live GROUP BY 1""")
def run_store(spark, sf_dir):
    """The runs that a log of creations, dispatches and ends leads to."""
    run = F.concat(F.col("execution_id"), F.lit("/"), F.date_format("ts", "yyyy-MM-dd"))
    events = tables.ledger(spark, sf_dir).select(run.alias("run_id"), F.col("ts").alias("at"), F.col("entry_id").alias("event_id"), _nth(_RUN_EVENTS, F.col("k") % 9).alias("move"))
    return control.run_states(events, "run_id")


_QUEUE_EVENTS = ("enqueue", "claim", "claim", "requeue", "enqueue", "claim", "dispatch", "requeue", "cancel")


@query("control_queue_log", f"""WITH RECURSIVE {LEDGER}, ev AS (SELECT execution_id || '/' || strftime(ts, '%Y-%m-%d') AS item_id, entry_id AS event_id, {_list(_QUEUE_EVENTS)}[(k % 9)::INT + 1] AS action, entry_id % 2 AS token,
    row_number() OVER (PARTITION BY item_id ORDER BY ts, entry_id) AS n FROM ledger),
  walk AS (SELECT DISTINCT item_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::VARCHAR AS outcome, NULL::VARCHAR AS status, NULL::BIGINT AS token FROM ev
    UNION ALL SELECT item_id, n, event_id, outcome,
      CASE outcome WHEN 'enqueued' THEN 'Pending' WHEN 'requeued' THEN 'Pending' WHEN 'claimed' THEN 'Claimed' WHEN 'dispatched' THEN 'Dispatched' WHEN 'cancelled' THEN 'Cancelled' ELSE status END,
      CASE outcome WHEN 'claimed' THEN own ELSE token END FROM (
      SELECT e.item_id, e.n, e.event_id, w.status, w.token, e.token AS own, CASE
        WHEN e.action = 'enqueue' THEN CASE WHEN w.status IS NULL THEN 'enqueued' ELSE 'duplicate' END WHEN w.status IS NULL THEN 'missing'
        WHEN e.action = 'claim' THEN CASE w.status WHEN 'Pending' THEN 'claimed' ELSE 'not-pending' END
        WHEN e.action = 'cancel' THEN CASE WHEN w.status IN ('Dispatched', 'Cancelled') THEN 'terminal' ELSE 'cancelled' END
        WHEN w.status <> 'Claimed' OR w.token <> e.token THEN 'not-owner' WHEN e.action = 'dispatch' THEN 'dispatched' ELSE 'requeued' END AS outcome
      FROM walk w JOIN ev e ON e.item_id = w.item_id AND e.n = w.n + 1) s)
  SELECT item_id, event_id, outcome, status FROM walk WHERE n > 0""")
def queue_log(spark, sf_dir):
    """What each enqueuing, claim, dispatch, return and cancelling of a queue's item comes to."""
    item = F.concat(F.col("execution_id"), F.lit("/"), F.date_format("ts", "yyyy-MM-dd"))
    events = tables.ledger(spark, sf_dir).select(item.alias("item_id"), F.col("ts").alias("at"), F.col("entry_id").alias("event_id"), _nth(_QUEUE_EVENTS, F.col("k") % 9).alias("action"), (F.col("entry_id") % 2).alias("token"))
    return control.queue_log(events)
