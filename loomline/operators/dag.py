"""State of step graphs: readiness, convergence, validation, replay. Whole tables of executions at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TERMINAL = ("Completed", "Failed")


def retry_due(now: Column) -> Column:
    """A waiting step without retry state is never due, one without a time always is."""
    return F.when(F.col("status") == "WaitingForRetry", F.when(~F.col("has_retry_state"), False).when(F.col("next_retry_at").isNull(), True).otherwise(F.col("next_retry_at") <= now)).otherwise(False)


def claimable(now: Column) -> Column:
    return F.col("status").isin("Ready", "None") | retry_due(now)


def lease_expired(now: Column) -> Column:
    return F.coalesce((F.col("status") == "Running") & (F.col("lease_expires_at") <= now), F.lit(False))


def ready_steps(steps: DataFrame, edges: DataFrame, now: Column) -> DataFrame:
    """Claimable steps all of whose parents exist and are completed."""
    done = steps.filter("status = 'Completed'").select("execution_id", F.col("step_no").alias("parent_no"))
    blocked = edges.join(done, ["execution_id", "parent_no"], "left_anti").select("execution_id", F.col("child_no").alias("step_no"))
    return steps.filter(claimable(now)).join(blocked, ["execution_id", "step_no"], "left_anti")


def progress_of_pending(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """Steps without status yet, and whether one can still progress: every parent exists, and none has failed or runs
    without a lease. Only parents count, not what lies above them."""
    alive = steps.filter("status <> 'Failed' and not (status = 'Running' and lease_expires_at is null)").select("execution_id", F.col("step_no").alias("parent_no"))
    dead = edges.join(alive, ["execution_id", "parent_no"], "left_anti").select("execution_id", F.col("child_no").alias("step_no"), F.lit(True).alias("dead")).distinct()
    pending = steps.filter("status = 'None'")
    return pending.join(dead, ["execution_id", "step_no"], "left").select("execution_id", "step_no", F.col("dead").isNull().alias("can_progress"))


def convergence(executions: DataFrame, steps: DataFrame, edges: DataFrame, now: Column) -> DataFrame:
    """Status of each execution: Completed if all steps are; Running if a step can run or runs under a lease; Waiting if
    something may still happen; else Failed if a step has failed, else Waiting, as an execution without steps is."""
    ready = ready_steps(steps, edges, now).filter("status in ('Ready', 'None')").select("execution_id", "step_no", F.lit(True).alias("ready"))
    rows = steps.join(ready, ["execution_id", "step_no"], "left").join(progress_of_pending(steps, edges), ["execution_id", "step_no"], "left")
    yes = lambda c: F.bool_or(F.coalesce(c, F.lit(False)))
    waits, runs = (F.col("status") == "WaitingForRetry") & F.col("has_retry_state"), F.col("status") == "Running"
    flags = rows.groupBy("execution_id").agg(
        F.count("*").alias("n"),
        F.bool_and(F.col("status") == "Completed").alias("all_completed"),
        yes(F.coalesce("ready", F.lit(False)) | F.coalesce(waits & (F.col("next_retry_at") <= now), F.lit(False)) | (runs & (F.col("lease_expires_at") > now))).alias("active"),
        yes(F.coalesce(waits & (F.col("next_retry_at") > now), F.lit(False)) | F.coalesce(runs & (F.col("lease_expires_at") <= now), F.lit(False)) | F.col("can_progress")).alias("later"),
        yes(F.col("status") == "Failed").alias("any_failed"),
    )
    status = F.when(F.col("n").isNull(), "Waiting").when(F.col("all_completed"), "Completed").when(F.col("active"), "Running").when(F.col("later"), "Waiting").when(F.col("any_failed"), "Failed").otherwise("Waiting")
    return executions.join(flags, "execution_id", "left").select("execution_id", status.alias("convergence"), F.coalesce("n", F.lit(0)).alias("steps"))


def issues(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def validate_definitions(steps: DataFrame) -> DataFrame:
    """Issues of (pipeline, step_name, step_key, retries, depends_on): blank name or key, negative retries, a name that
    occurs again, and a blank, own or missing dependency."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    named = lambda df, issue: df.select("pipeline", F.coalesce("step_name", F.lit("")).alias("step_name"), F.lit(issue).alias("issue"))
    needs = steps.select("pipeline", "step_name", F.explode("depends_on").alias("parent"))
    known = steps.select("pipeline", F.col("step_name").alias("parent")).distinct()
    again = steps.filter(~blank("step_name")).groupBy("pipeline", "step_name").agg(F.count("*").alias("n")).filter("n > 1")
    return issues(
        named(steps.filter(blank("step_name")), "BlankName"),
        named(steps.filter(blank("step_key")), "BlankKey"),
        named(steps.filter("retries < 0"), "NegativeRetries"),
        named(again, "DuplicateName"),
        named(needs.filter(blank("parent")), "BlankDependency"),
        named(needs.filter("parent = step_name"), "SelfDependency"),
        named(needs.filter(~blank("parent")).join(known, ["pipeline", "parent"], "left_anti"), "MissingDependency"),
    )


def cyclic(edges: DataFrame, group: str, folder: str) -> DataFrame:
    """Nodes on a cycle or behind one: what is left after steps without open parents are taken away again and again.

    Each round is written and read again, so plans don't grow; rounds are as many as the longest path has steps.
    """
    spark, left, k, before = edges.sparkSession, edges.select(group, "child", "parent").distinct(), 0, None
    while True:
        children = left.select(group, F.col("child").alias("parent")).distinct()
        path = f"{folder}/open-{k}"
        left.join(children, [group, "parent"], "left_semi").write.mode("overwrite").parquet(path)
        left = spark.read.parquet(path)
        n = left.count()
        if n == before or n == 0:
            return left.select(group, F.col("child").alias("node")).distinct()
        before, k = n, k + 1


def resolve_steps(hot: DataFrame, archived: DataFrame, keys: list[str]) -> DataFrame:
    """Hot steps and those archived ones that aren't hot."""
    return hot.unionByName(archived.join(hot.select(*keys), keys, "left_anti"))


def reconstruct(blob: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """A step's record wins over the state's copy, unless only the copy is terminal."""
    b, r = blob.select(*keys, F.col("status").alias("b")), records.select(*keys, F.col("status").alias("r"))
    keep = F.col("b").isin(*TERMINAL) & (F.col("r").isNull() | ~F.col("r").isin(*TERMINAL))
    return b.join(r, keys, "full").select(*keys, F.when(keep, F.col("b")).otherwise(F.coalesce("r", "b")).alias("status"))


def fingerprints(steps: DataFrame) -> DataFrame:
    """SHA-256, in capitals, of each execution's sorted step names, statuses and counts."""
    part = F.concat_ws("|", "step_name", "status", "retry_count", "recovery_count")
    rows = F.array_sort(F.collect_list(F.struct("step_name", part.alias("part"))))
    return steps.groupBy("execution_id").agg(F.upper(F.sha2(F.array_join(F.transform(rows, lambda x: x["part"]), ","), 256)).alias("fingerprint"))


def stale(rows: DataFrame, completed: DataFrame) -> DataFrame:
    """Rows of status None without result and completion time whose name is in the execution's completed set."""
    open_rows = rows.filter("status = 'None' and result is null and completed_at is null and trim(step_name) <> ''")
    return open_rows.join(completed.select("execution_id", "step_name"), ["execution_id", "step_name"], "left_semi")


def recovered(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """keys, before and after of the steps whose recovery count has risen."""
    a, b = before.select(*keys, F.col("recovery_count").alias("before")), after.select(*keys, F.col("recovery_count").alias("after"))
    return a.join(b, keys).filter("after > before")


def states_by_name(defined: DataFrame, states: DataFrame) -> DataFrame:
    """execution_id, step_name and status of every step that is defined; None where it has no state."""
    found = states.select("execution_id", "step_name", "status")
    return defined.join(found, ["execution_id", "step_name"], "left").select("execution_id", "step_name", F.coalesce("status", F.lit("None")).alias("status"))
