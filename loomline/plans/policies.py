"""Queries of retry, retention and concurrency policies, and of memories."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.operators import memory, policy
from loomline.registry import query
from loomline.sources import tables
from loomline.sources.tables import LEDGER, STEPS


@query("policy_backoff", f"WITH {STEPS} SELECT execution_id, step_no, greatest(0.0, least(CASE WHEN step_no % 2 = 0 THEN 500 * power(2.0, retry_count) ELSE 500.0 END, 3000.0))::DOUBLE AS delay_ms FROM steps")
def backoff(spark, sf_dir):
    kind = F.when(F.col("step_no") % 2 == 0, "Exponential").otherwise("Linear")
    return tables.steps(spark, sf_dir).select("execution_id", "step_no", policy.backoff(kind, F.lit(500), F.col("retry_count"), F.lit(3000)).alias("delay_ms"))


@query("policy_classifiers", """SELECT event_id, contains(lower('the ' || event_type || CASE WHEN event_id % 3 = 0 THEN ' Timeout' ELSE ' generated' END), 'rate') OR contains(CASE WHEN event_id % 5 = 0 THEN 'HTTP 429' ELSE '' END, '429') AS rate_limited,
  event_id % 3 = 0 AS timed_out FROM events""")
def classifiers(spark, sf_dir):
    """X12 and X13; "generated" has "rate" in it, which counts."""
    reason = F.concat(F.lit("the "), "event_type", F.when(F.col("event_id") % 3 == 0, " Timeout").otherwise(" generated"))
    error = F.when(F.col("event_id") % 5 == 0, "HTTP 429")
    return tables.table(spark, sf_dir, "events").select("event_id", policy.rate_limited(reason, error).alias("rate_limited"), policy.timed_out(reason).alias("timed_out"))


_OUTCOMES = f"""{LEDGER}, o AS (SELECT execution_id, entry_id AS idx, k = 99 AND execution_id % 3 = 0 AS blocked, k % 3 = 0 AS retryable, CASE WHEN k % 2 = 0 THEN k * 10 END AS suggested_ms, CASE WHEN k % 5 <> 0 THEN event_type ELSE ' ' END AS reason FROM ledger)"""


def _outcomes(spark, sf_dir):
    k = F.col("k")
    """Every entry of the ledger as one policy's outcome: blocks in every third execution, waits and reasons as they come."""
    rows = tables.ledger(spark, sf_dir)
    return rows.select("execution_id", F.col("entry_id").alias("idx"), ((k == 99) & (F.col("execution_id") % 3 == 0)).alias("blocked"), (k % 3 == 0).alias("retryable"), F.when(k % 2 == 0, k * 10).alias("suggested_ms"), F.when(k % 5 != 0, F.col("event_type")).otherwise(" ").alias("reason"), (F.col("execution_id") % 4).alias("retries"), F.lit(3).alias("budget"))


@query("policy_retry_fold", f"""WITH {_OUTCOMES}, f AS (SELECT execution_id, bool_or(blocked) OR execution_id % 4 >= 3 OR NOT bool_or(retryable) AS fail, max(suggested_ms) AS s, arg_min(reason, idx) FILTER (trim(reason) <> '') AS reason FROM o GROUP BY execution_id)
  SELECT execution_id, CASE WHEN fail THEN 'Fail' ELSE 'Retry' END AS decision, CASE WHEN NOT fail THEN coalesce(s, 500) END AS delay_ms, reason FROM f""")
def retry_fold(spark, sf_dir):
    return policy.fold_retry(_outcomes(spark, sf_dir), ["execution_id"], 500)


@query("policy_concurrency_fold", f"""WITH {_OUTCOMES} SELECT execution_id, NOT bool_or(blocked) AND bool_and(idx % 211 <> 0) AS allowed, CASE WHEN bool_or(blocked) OR NOT bool_and(idx % 211 <> 0) THEN coalesce(max(suggested_ms), 250) END AS retry_after_ms FROM o GROUP BY 1""")
def concurrency_fold(spark, sf_dir):
    rows = _outcomes(spark, sf_dir).withColumn("allowed", F.col("idx") % 211 != 0).withColumn("retry_after_ms", F.col("suggested_ms"))
    return policy.fold_concurrency(rows, ["execution_id"], 250)


@query("policy_compaction", f"WITH {STEPS} SELECT execution_id, step_no, inline_bytes FROM steps WHERE status IN ('Completed', 'Failed') AND inline_bytes > 40000")
def compaction(spark, sf_dir):
    return policy.compaction_candidates(tables.steps(spark, sf_dir), 40000).select("execution_id", "step_no", "inline_bytes")


_EVICT = """evict AS (SELECT execution_id, step_no FROM (SELECT *, count(*) OVER (PARTITION BY execution_id) AS n, row_number() OVER (PARTITION BY execution_id ORDER BY completed_at NULLS LAST, step_name) AS p FROM steps WHERE status = 'Completed' AND NOT is_evicted) WHERE p <= least(n - 1, 10))"""


@query("policy_eviction", f"WITH {STEPS}, {_EVICT} SELECT * FROM evict")
def eviction(spark, sf_dir):
    return policy.eviction_candidates(tables.steps(spark, sf_dir), 1).select("execution_id", "step_no")


@query("policy_compact_only", f"WITH {STEPS}, {_EVICT} SELECT execution_id, step_no FROM steps WHERE status IN ('Completed', 'Failed') AND inline_bytes > 40000 EXCEPT SELECT * FROM evict")
def compact_only(spark, sf_dir):
    """What is compacted and not evicted."""
    steps, keys = tables.steps(spark, sf_dir), ["execution_id", "step_no"]
    evicted = policy.eviction_candidates(steps, 1)
    return policy.compaction_candidates(steps, 40000).join(evicted.select(*keys), keys, "left_anti").select(*keys)


@query("policy_retention_fold", f"""WITH {STEPS}, {_EVICT}, c AS (SELECT execution_id, step_no, 1 AS kind FROM steps WHERE status IN ('Completed', 'Failed') AND inline_bytes > 40000 UNION ALL SELECT execution_id, step_no, 2 FROM evict)
  SELECT execution_id, count(DISTINCT step_no) AS steps, CASE max(kind) WHEN 2 THEN 'Evict' ELSE 'Compact' END AS kind FROM c GROUP BY 1""")
def retention_fold(spark, sf_dir):
    """The union of the policies' steps, and the kind that comes first."""
    steps = tables.steps(spark, sf_dir)
    rows = policy.compaction_candidates(steps, 40000).select("execution_id", "step_no", F.lit(1).alias("kind")).unionByName(policy.eviction_candidates(steps, 1).select("execution_id", "step_no", F.lit(2).alias("kind")))
    return rows.groupBy("execution_id").agg(F.count_distinct("step_no").alias("steps"), F.when(F.max("kind") == 2, "Evict").otherwise("Compact").alias("kind"))


@query("policy_retention_patch", f"""WITH {STEPS} SELECT CASE WHEN is_evicted OR status NOT IN ('Completed', 'Failed') THEN 'skipped' WHEN step_no % 2 = 0 THEN 'compacted' ELSE 'evicted' END AS outcome, count(*) AS n FROM steps GROUP BY 1""")
def retention_patch(spark, sf_dir):
    """Each candidate is checked again when the patch is applied."""
    terminal = F.col("status").isin("Completed", "Failed")
    outcome = F.when(F.col("is_evicted") | ~terminal, "skipped").when(F.col("step_no") % 2 == 0, "compacted").otherwise("evicted")
    return tables.steps(spark, sf_dir).groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("policy_retention_trigger", f"WITH {STEPS} SELECT execution_id, count(*) AS n_steps, count(*) FILTER (status = 'Completed') AS n_completed, max(inline_bytes) AS most_bytes, count(*) > 6 OR count(*) FILTER (status = 'Completed') > 3 OR max(inline_bytes) > 90000 AS triggered FROM steps GROUP BY 1")
def retention_trigger(spark, sf_dir):
    return policy.triggered(tables.steps(spark, sf_dir), 6, 3, 90000)


@query("policy_hybrid", f"WITH {STEPS} SELECT execution_id, count(*) AS both_kinds FROM steps WHERE status IN ('Completed', 'Failed') GROUP BY 1")
def hybrid(spark, sf_dir):
    """every terminal step is a candidate of both kinds."""
    return policy.compaction_candidates(tables.steps(spark, sf_dir), None).groupBy("execution_id").agg(F.count("*").alias("both_kinds"))


@query("policy_admission", "SELECT s_suppkey, s_nationkey % 5 <> 0 AND s_nationkey % 5 <> 4 AS admitted FROM supplier")
def admission(spark, sf_dir):
    """F8: one provider is blocked, another one isn't on the list; names compare without case and blanks."""
    rows = tables.table(spark, sf_dir, "supplier").withColumn("provider", F.concat(F.lit(" P"), F.col("s_nationkey") % 5))
    blocked = spark.createDataFrame([("P0 ",)], "name string")
    allowed = spark.createDataFrame([("p0",), ("p1",), ("P2",), ("p3",)], "name string")
    return policy.admission(rows, "provider", blocked, allowed).select("s_suppkey", "admitted")


@query("policy_throttle_rules", """WITH rules(idx, scope, target, max_n, lease_s) AS (VALUES (0, 'segment', 'BUILDING', 3, NULL), (1, 'nation', '', 9, 30), (2, 'segment', '', 5, 60), (3, 'nation', '7', 2, 90)),
  hit AS (SELECT c_custkey, r.* FROM customer c JOIN rules r ON r.target = '' OR r.scope = 'segment' AND r.target = c.c_mktsegment OR r.scope = 'nation' AND r.target = c.c_nationkey::VARCHAR)
  SELECT c_custkey, (arg_min(max_n, idx) FILTER (scope = 'segment'))::INT AS segment_max, (arg_min(max_n, idx) FILTER (scope = 'nation'))::INT AS nation_max, (arg_max(lease_s, idx) FILTER (lease_s IS NOT NULL))::INT AS lease_s FROM hit GROUP BY 1""")
def throttle_rules(spark, sf_dir):
    """The first matching rule of a scope gives its limit, the last one with a lease the lease. A context
    has one value for each scope, so rules are found by (scope, target), a blank target by (scope, "")."""
    rules = spark.createDataFrame([(0, "segment", "BUILDING", 3, None), (1, "nation", "", 9, 30), (2, "segment", "", 5, 60), (3, "nation", "7", 2, 90)], "idx int, scope string, target string, max_n int, lease_s int")
    c = tables.table(spark, sf_dir, "customer")
    wanted = F.array(*(F.struct(F.lit(s).alias("scope"), v.alias("target")) for s, t in (("segment", F.col("c_mktsegment")), ("nation", F.col("c_nationkey").cast("string"))) for v in (t, F.lit(""))))
    hit = c.select("c_custkey", F.explode(wanted).alias("x")).select("c_custkey", "x.scope", "x.target").join(F.broadcast(rules), ["scope", "target"])
    first = lambda scope: F.min_by("max_n", F.when(F.col("scope") == scope, F.col("idx")))
    return hit.groupBy("c_custkey").agg(first("segment").alias("segment_max"), first("nation").alias("nation_max"), F.max_by("lease_s", F.when(F.col("lease_s").isNotNull(), F.col("idx"))).alias("lease_s"))


@query("policy_lease_semaphore")
def lease_semaphore(spark, sf_dir):
    """Whether each request of an execution gets a lease in all of its scopes (the execution, the kind of event and the
    hour's instance), given those before it; errors release. Depends on its own outcomes, so it has no SQL."""
    e = tables.ledger(spark, sf_dir)
    scope = lambda name, cap: F.struct(name.alias("name"), F.lit(cap).alias("cap"))
    scopes = F.array(scope(F.lit("execution"), 6), scope(F.concat(F.lit("kind:"), "event_type"), 2), scope(F.concat(F.lit("instance:"), F.hour("ts")), 3))
    action = F.when(F.col("event_type") == "error", "release").otherwise("acquire")
    rows = e.select(F.col("execution_id").alias("root"), F.col("ts").alias("at"), F.col("entry_id").alias("seq"), action.alias("action"), (F.col("entry_id") % 20).alias("lease_id"), (F.col("k") * 1800000).alias("lease_ms"), scopes.alias("scopes"))
    return policy.lease_admission(rows)


_MEMORIES = """m AS (SELECT c_custkey AS memory_id, c_mktsegment AS scope, (c_custkey % 11) / 10.0::DOUBLE AS relevance, (c_custkey % 7) / 6.0::DOUBLE AS novelty, (c_nationkey % 5) / 4.0::DOUBLE AS confidence, count(event_id) AS accesses, c_custkey % 9 AS age FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY ALL),
  s AS (SELECT *, greatest(0.0, least(1.0, 0.45::DOUBLE * relevance + 0.30::DOUBLE * novelty + 0.25::DOUBLE * confidence)) AS i FROM m),
  scored AS (SELECT *, greatest(0.0, least(1.0, i * (1 + ln(1.0 + accesses)) / (1 + ln(1.0 + age) * greatest(0.1::DOUBLE, relevance)))) AS c FROM s)"""


def _memories(spark, sf_dir):
    key = F.col("c_custkey")
    used = tables.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias("accesses"))
    rows = tables.table(spark, sf_dir, "customer").join(used, "c_custkey", "left").select(key.alias("memory_id"), F.col("c_mktsegment").alias("scope"), (key % 11 / 10.0).alias("relevance"), (key % 7 / 6.0).alias("novelty"), (F.col("c_nationkey") % 5 / 4.0).alias("confidence"), F.coalesce("accesses", F.lit(0)).alias("accesses"), (key % 9).alias("age"))
    rows = rows.withColumn("i", memory.initial_score(F.col("relevance"), F.col("novelty"), F.col("confidence")))
    return rows.withColumn("c", memory.current_score(F.col("i"), F.col("accesses"), F.col("age"), F.col("relevance")))


@query("memory_scores", f"WITH {_MEMORIES} SELECT memory_id, round(i, 6) AS initial, round(c, 6) AS current FROM scored")
def memory_scores(spark, sf_dir):
    return _memories(spark, sf_dir).select("memory_id", F.round("i", 6).alias("initial"), F.round("c", 6).alias("current"))


@query("memory_lifecycle", f"WITH {_MEMORIES} SELECT memory_id, CASE WHEN round(c, 9) <= 0.05 AND accesses = 0 AND age > 1 THEN 'prune' WHEN round(c, 9) >= 0.75 AND confidence >= 0.70 THEN 'promote' WHEN round(c, 9) >= 0.20 THEN 'active' ELSE 'inactive' END AS fate, age + 1 AS age FROM scored")
def memory_lifecycle(spark, sf_dir):
    """What becomes of each memory as it ages by one session."""
    return _memories(spark, sf_dir).select("memory_id", memory.lifecycle(F.round("c", 9), F.col("confidence"), F.col("accesses"), F.col("age")).alias("fate"), (F.col("age") + 1).alias("age"))


@query("memory_search", f"WITH {_MEMORIES} SELECT memory_id, round(c, 6) AS score FROM scored WHERE scope = 'BUILDING' AND round(c, 9) >= 0.2 ORDER BY round(c, 9) DESC, memory_id LIMIT 25")
def memory_search(spark, sf_dir):
    rows = _memories(spark, sf_dir).filter((F.col("scope") == "BUILDING") & (F.round("c", 9) >= 0.2))
    return rows.orderBy(F.round("c", 9).desc(), "memory_id").limit(25).select("memory_id", F.round("c", 6).alias("score"))


@query("memory_writer", f"WITH {STEPS} SELECT execution_id, step_no, 0.5::DOUBLE AS relevance, 0.5::DOUBLE AS novelty, 0.8::DOUBLE AS confidence, 'bytes=' || inline_bytes AS content FROM steps WHERE status = 'Completed' AND inline_bytes > 0")
def memory_writer(spark, sf_dir):
    """Results that carry something become memories with constant scores."""
    rows = tables.steps(spark, sf_dir).filter("status = 'Completed' and inline_bytes > 0")
    return rows.select("execution_id", "step_no", F.lit(0.5).alias("relevance"), F.lit(0.5).alias("novelty"), F.lit(0.8).alias("confidence"), F.concat(F.lit("bytes="), "inline_bytes").alias("content"))
