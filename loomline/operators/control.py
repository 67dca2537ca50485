"""Control plane: admission, queues, permissions, registries and folds of event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.operators import folds, ordered
from loomline.sources import shared

ENDED = ("Cancelled", "Completed", "Failed")


def eligible_instances(instances: DataFrame, paused: bool = False, draining: bool = False, unhealthy: bool = False) -> DataFrame:
    out = ["Stopped"] + ["Paused"] * (not paused) + ["Draining"] * (not draining) + ["Unhealthy"] * (not unhealthy)
    return instances.filter(~F.col("status").isin(*out))


def least_loaded(instances: DataFrame, group: list[str], preferred: Column | None = None) -> DataFrame:
    """The instance of each group with the fewest running, then queued runs; a preferred one comes first."""
    first = [F.when(preferred, 0).otherwise(1)] if preferred is not None else []
    w = Window.partitionBy(*group).orderBy(*first, "running", "queued", "instance_id")
    return instances.withColumn("place", F.row_number().over(w)).filter("place = 1").drop("place")


def queue_order(items: DataFrame, group: list[str]) -> DataFrame:
    """Pending items of each group by priority (the lowest first), time and id."""
    w = Window.partitionBy(*group).orderBy("priority", "enqueued_at", "item_id")
    return items.filter("status = 'Pending'").withColumn("place", F.row_number().over(w))


def queue_score(priority: Column, at_ms: Column) -> Column:
    return priority.cast("double") * 1e12 + at_ms.cast("double")


#: What a check accepts: segments of the request, None for a whole segment of "*".
KEYS = {
    "exact": [("resource", "feature", "action"), ("resource", "feature", None), ("resource", None, "action"), ("resource", None, None), (None, None, "action"), (None, None, None)],
    "resource": [("resource", None, None), (None, None, None)],
    "feature": [("resource", "feature", None), ("resource", None, None), (None, None, None)],
    "any_action": [(None, None, "action"), (None, None, None)],
}


def granted(grants: DataFrame, requests: DataFrame, check: str = "exact") -> DataFrame:
    """allowed for each request (project, ns, resource, feature, action): a grant of the same project and namespace is
    exact or has whole segments of "*" in one of the places that the check accepts. The coarser checks ask for a whole
    resource, a whole feature, or an action on everything."""
    parts = F.split(F.lower(F.trim("trn")), ":")
    names = ["project", "ns", "resource", "feature", "action"]
    rows = grants.select(parts.alias("p")).filter((F.size("p") == 6) & (F.col("p")[0] == "trn")).select(*(F.col("p")[k + 1].alias(n) for k, n in enumerate(names))).distinct()
    # Each accepted pattern is one key of the request, so the lookup is an equi-join.
    key = lambda *c: F.concat_ws(":", F.lower("project"), F.lower("ns"), *c)
    wanted = requests.withColumn("key", F.explode(F.array(*(key(*(F.lower(c) if c else F.lit("*") for c in k)) for k in KEYS[check]))))
    held = rows.select(key("resource", "feature", "action").alias("key")).distinct()
    hit = wanted.join(held, "key", "left_semi").select("request_id").distinct().withColumn("hit", F.lit(True))
    return requests.join(hit, "request_id", "left").withColumn("allowed", F.coalesce("hit", F.lit(False))).drop("hit")


def first_terminal(events: DataFrame, key: str) -> DataFrame:
    """Finalisation: the first terminal event of a key holds, later ones are refused."""
    done = events.filter(F.col("status").isin(*ENDED))
    return done.groupBy(key).agg(F.min_by("status", F.struct("at", "event_id")).alias("status"), F.min(F.struct("at", "event_id"))["at"].alias("at"), (F.count("*") - 1).alias("refused"))


def may_cleanup(status: Column, completed: bool = True, failed: bool = False) -> Column:
    return F.when(status == "Completed", F.lit(completed)).when(status == "Failed", F.lit(failed)).otherwise(F.lit(False))


def control_gate(status: Column) -> Column:
    return F.when(status.isin("Cancelled", "Cancelling"), "Cancel").when(status.isin("Paused", "Pausing", "WaitingForInput"), "StopClaiming").otherwise("Continue")


def first_unheld(candidates: DataFrame, helpers: DataFrame, held: DataFrame, n: int) -> DataFrame:
    """helper and execution_id: of the candidates (execution_id, zone) of a helper's zone, in order with null last, the
    first n of which it holds no lease (execution_id, helper). A helper that is there twice takes each candidate twice.

    Candidates aren't paired with helpers. They have places in their zone, and the k-th unheld one is at place k plus the
    number of held ones before it: of those held ones that, as i-th of their helper, have a place under i + k. A helper
    with m leases needs no place over n + m; places that none of a zone needs are dropped, and the others written once.
    """
    leases = held.groupBy("helper").agg(F.count("*").alias("leases"))
    helpers = helpers.groupBy("helper", "zone").agg(F.count("*").alias("copies")).join(leases, "helper", "left")
    helpers = helpers.select("helper", "zone", "copies", (F.coalesce("leases", F.lit(0)) + n).alias("need"))
    places = candidates.filter(F.col("zone").isNotNull()).select("zone", "execution_id").distinct()
    places = ordered.running(places, ["zone"], [F.asc_nulls_last("execution_id")], "place")
    places = places.join(helpers.groupBy("zone").agg(F.max("need").alias("most")), "zone").filter("place <= most").drop("most")
    places = shared.written(places, shared.folder(places.sparkSession, "places"))
    near = held.join(places, "execution_id", "left_semi").distinct()
    taken = near.join(helpers, "helper").join(places, ["execution_id", "zone"]).filter("place <= need").select("helper", "zone", "place")
    taken = ordered.running(taken, ["helper", "zone"], [F.col("place")], "nth")
    before = taken.groupBy("helper", "zone").agg(F.array(*(F.count_if(F.col("place") < F.col("nth") + k) for k in range(1, n + 1))).alias("before"))
    wanted = helpers.join(before, ["helper", "zone"], "left").withColumn("row", F.explode(F.sequence(F.lit(1), F.lit(n))))
    k = F.ceil(F.col("row") / F.col("copies"))
    wanted = wanted.select("helper", "zone", (k + F.coalesce(F.get("before", k.cast("int") - 1), F.lit(0))).alias("place"))
    return wanted.join(places, ["zone", "place"]).select("helper", "execution_id")


_OPEN = ("Running", "Pausing", "Paused", "Resuming", "WaitingForInput")
CONTROL_STATES = (*_OPEN, "Cancelling", "Cancelled")
#: What a move makes of a state; where none is named, the state stays. Cancelling and Cancelled absorb all but cancelling.
CONTROL_MOVES = {
    "pause": {s: "Pausing" for s in _OPEN if s != "Paused"},
    "mark_paused": {"Pausing": "Paused"},
    "resume": dict.fromkeys(_OPEN, "Resuming"),
    "wait": dict.fromkeys(_OPEN, "WaitingForInput"),
    "input": dict.fromkeys(_OPEN, "Resuming"),
    "wrong_input": {},
    "mark_running": {"Resuming": "Running"},
    "cancel": dict.fromkeys((*_OPEN, "Cancelling"), "Cancelling"),
    "mark_cancelled": dict.fromkeys(CONTROL_STATES, "Cancelled"),
}


def control_states(events: DataFrame, key: str) -> DataFrame:
    """key, status, changes and errors from (key, at, event_id, action, input_key): input counts where its key is that of
    the last wait, else it is an error. Only a cancelled execution ignores a wait, and it ignores input as well, so the
    last wait's key is that of the log."""
    before = Window.partitionBy(key).orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    waited = F.last(F.when(F.col("action") == "wait", F.col("input_key")), ignorenulls=True).over(before)
    fits = F.coalesce(waited == F.col("input_key"), F.lit(False))
    moves = events.withColumn("move", F.when((F.col("action") == "input") & ~fits, "wrong_input").otherwise(F.col("action")))
    return folds.final_states(moves, key, CONTROL_STATES, CONTROL_MOVES, {"wrong_input": _OPEN})


RUN_STATES = ("missing", "Pending", "Dispatched", *ENDED)
_LIVE = ("Pending", "Dispatched")
RUN_MOVES = {
    "create": {"missing": "Pending"},
    "dispatch": dict.fromkeys(_LIVE, "Dispatched"),
    "cancel": dict.fromkeys(_LIVE, "Cancelled"),
    "complete": dict.fromkeys(_LIVE, "Completed"),
    "fail": dict.fromkeys(_LIVE, "Failed"),
}


def run_states(events: DataFrame, key: str) -> DataFrame:
    """key, status, changes and errors of runs: the first creation holds, and what has ended stays; other moves of a run
    that is missing or has ended, and further creations, are errors."""
    refused = {m: ("missing", *ENDED) for m in RUN_MOVES} | {"create": RUN_STATES[1:]}
    return folds.final_states(events, key, RUN_STATES, RUN_MOVES, refused)


def queue_log(events: DataFrame) -> DataFrame:
    """outcome of each event (item_id, at, event_id, action, token) of a queue's items, and the item's status after it.

    A known item is enqueued no second time; only a pending one is claimed; only the holder of the claim's token marks it
    dispatched or sends it back; all but dispatched and cancelled ones are cancelled. The state is a status and a token.
    """

    def step(item: dict, row: dict) -> dict:
        status, action = item["status"], row["action"]
        owner = status == "Claimed" and item["token"] == row["token"]
        if action == "enqueue":
            outcome, new = ("duplicate", status) if status else ("enqueued", "Pending")
        elif status is None:
            outcome, new = "missing", None
        elif action == "claim":
            outcome, new = ("claimed", "Claimed") if status == "Pending" else ("not-pending", status)
            if outcome == "claimed":
                item["token"] = row["token"]
        elif action == "cancel":
            outcome, new = ("terminal", status) if status in ("Dispatched", "Cancelled") else ("cancelled", "Cancelled")
        elif action in ("dispatch", "requeue"):
            done = ("dispatched", "Dispatched") if action == "dispatch" else ("requeued", "Pending")
            outcome, new = done if owner else ("not-owner", status)
        else:
            outcome, new = "unknown", status
        item["status"] = new
        return {"item_id": row["item_id"], "event_id": row["event_id"], "outcome": outcome, "status": new}

    rows = events.select(F.col("item_id").cast("string").alias("item_id"), "at", F.col("event_id").cast("long").alias("event_id"), "action", "token")
    return folds.streamed(rows, "item_id", ["at", "event_id"], lambda: {"status": None, "token": None}, step, "item_id string, event_id long, outcome string, status string")
