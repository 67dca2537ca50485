"""Retry, retention and concurrency policies as column expressions and folds."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.operators import folds


def backoff(kind: Column, base_ms: Column, retries: Column, cap_ms: Column) -> Column:
    """Milliseconds to wait: doubled by each retry if exponential, else the base; at most the cap, at least 0."""
    raw = F.when(F.lower(kind) == "exponential", base_ms * F.pow(F.lit(2.0), retries)).otherwise(base_ms.cast("double"))
    return F.greatest(F.lit(0.0), F.least(raw, cap_ms.cast("double")))


def rate_limited(reason: Column, error: Column) -> Column:
    low = F.lower(F.coalesce(reason, F.lit("")))
    return F.coalesce(error, F.lit("")).contains("429") | low.contains("rate") | low.contains("throttle")


def timed_out(reason: Column) -> Column:
    return F.lower(F.coalesce(reason, F.lit(""))).contains("timeout")


def fold_retry(outcomes: DataFrame, keys: list[str], default_ms: int) -> DataFrame:
    """One decision for each key from rows (idx, blocked, retryable, suggested_ms, reason, retries, budget)."""
    said = F.min_by("reason", F.when(F.coalesce(F.trim("reason"), F.lit("")) != "", F.col("idx")))
    rows = outcomes.groupBy(*keys).agg(F.bool_or("blocked").alias("blocked"), F.bool_or("retryable").alias("retryable"), F.max("suggested_ms").alias("suggested"), said.alias("reason"), F.max(F.col("retries") >= F.col("budget")).alias("spent"))
    fail = F.col("blocked") | F.col("spent") | ~F.col("retryable")
    return rows.select(*keys, F.when(fail, "Fail").otherwise("Retry").alias("decision"), F.when(~fail, F.coalesce("suggested", F.lit(default_ms))).cast("long").alias("delay_ms"), "reason")


def fold_concurrency(outcomes: DataFrame, keys: list[str], default_ms: int) -> DataFrame:
    """Denied if any policy blocks or disallows, with the longest wait."""
    rows = outcomes.groupBy(*keys).agg(F.bool_or("blocked").alias("blocked"), F.bool_and("allowed").alias("allowed"), F.max("retry_after_ms").alias("wait"))
    ok = ~F.col("blocked") & F.col("allowed")
    return rows.select(*keys, ok.alias("allowed"), F.when(~ok, F.coalesce("wait", F.lit(default_ms))).cast("long").alias("retry_after_ms"))


def compaction_candidates(steps: DataFrame, threshold: int | None) -> DataFrame:
    """Terminal steps with more inline bytes than threshold, or all of them where the trigger is off (None)."""
    done = steps.filter("status in ('Completed', 'Failed')")
    return done if threshold is None else done.filter(F.col("inline_bytes") > threshold)


def eviction_candidates(steps: DataFrame, keep: int, per_pass: int = 10) -> DataFrame:
    """The oldest completed steps beyond keep, at most per_pass of an execution."""
    done = steps.filter("status = 'Completed' and not is_evicted")
    by = Window.partitionBy("execution_id")
    rows = done.withColumn("n", F.count("*").over(by)).withColumn("place", F.row_number().over(by.orderBy(F.col("completed_at").asc_nulls_last(), "step_name")))
    return rows.filter(F.col("place") <= F.least(F.col("n") - keep, F.lit(per_pass))).drop("n", "place")


def triggered(steps: DataFrame, max_steps: int, max_completed: int, max_bytes: int) -> DataFrame:
    rows = steps.groupBy("execution_id").agg(F.count("*").alias("n_steps"), F.count_if(F.col("status") == "Completed").alias("n_completed"), F.max("inline_bytes").alias("most_bytes"))
    return rows.withColumn("triggered", (F.col("n_steps") > max_steps) | (F.col("n_completed") > max_completed) | F.coalesce(F.col("most_bytes") > max_bytes, F.lit(False)))


def admission(rows: DataFrame, value: str, blocked: DataFrame, allowed: DataFrame) -> DataFrame:
    """admitted: not on the block list, and on the allow list unless that is empty. Names compare trimmed, lower-cased."""
    canonical = lambda c: F.lower(F.trim(c))
    b = blocked.select(canonical("name").alias("b")).distinct()
    a = allowed.select(canonical("name").alias("a")).distinct()
    listed = bool(allowed.take(1))
    out = rows.withColumn("v", canonical(value)).join(b, F.col("v") == F.col("b"), "left").join(a, F.col("v") == F.col("a"), "left")
    return out.withColumn("admitted", F.col("b").isNull() & (F.col("a").isNotNull() | F.lit(not listed))).drop("v", "a", "b")


def lease_admission(requests: DataFrame) -> DataFrame:
    """Leases over several scopes at once, from (root, at, seq, action, lease_id, lease_ms, scopes array of (name, cap)).

    "acquire" is granted if every scope with a positive cap has room after expired leases are gone, and then holds in all
    of them until at + lease_ms; else nothing is held, and blocked is the first full scope with its held leases and the
    milliseconds until one of them ends. A lease that is held already doesn't count twice and is prolonged. "release"
    ends a lease in its scopes. Each outcome depends on those before it, so all requests of a root, which bounds its
    scopes, are folded in the order of at and seq, one by one; what is kept is the leases held. A null root is a root,
    scopes without a cap or a null list always have room.
    """

    def step(state: dict, row: dict) -> dict:
        held = state["held"]
        now, lease = row["at"], row["lease_id"]
        out = dict(root=row["root"], at=now, seq=row["seq"], lease_id=lease, granted=None, blocked=None, held=None, retry_after_ms=None)
        caps = [(s["name"], s["cap"]) for s in row["scopes"] or () if s["cap"] and s["cap"] > 0]
        if row["action"] == "release":
            for name in {s["name"] for s in row["scopes"] or ()}:
                held.get(name, {}).pop(lease, None)
            return out
        for name, cap in caps:
            live = held[name] = {k: end for k, end in held.get(name, {}).items() if end > now}
            if lease not in live and len(live) >= cap:
                wait = (min(live.values()) - now) // timedelta(milliseconds=1)
                return out | dict(granted=False, blocked=name, held=len(live), retry_after_ms=wait)
        end = now + timedelta(milliseconds=row["lease_ms"])
        for name, _ in caps:
            held[name][lease] = end
        # Scopes that nobody asks for any more mustn't stay.
        if len(held) > 2 * state["swept"]:
            for name in [n for n, live in held.items() if all(e <= now for e in live.values())]:
                del held[name]
            state["swept"] = max(512, len(held))
        return out | dict(granted=True, held=max((len(held[n]) for n, _ in caps if n in held), default=0))

    schema = "root string, at timestamp_ntz, seq long, lease_id long, granted boolean, blocked string, held int, retry_after_ms long"
    rows = requests.select(F.col("root").cast("string").alias("root"), "at", F.col("seq").cast("long").alias("seq"), "action", "lease_id", "lease_ms", "scopes")
    return folds.streamed(rows, "root", ["at", "seq"], lambda: {"held": {}, "swept": 512}, step, schema)


def lease_semaphore(requests: DataFrame, limit: int) -> DataFrame:
    """The same for one scope with one limit, from (scope, at, lease_id, lease_ms)."""
    one = F.array(F.struct(F.col("scope").alias("name"), F.lit(limit).alias("cap")))
    rows = requests.select(F.col("scope").alias("root"), "at", F.col("lease_id").alias("seq"), F.lit("acquire").alias("action"), "lease_id", "lease_ms", one.alias("scopes"))
    return lease_admission(rows).select(F.col("root").alias("scope"), "at", "lease_id", "granted", "held", "retry_after_ms")
