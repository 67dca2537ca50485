"""Folds of event logs in the order of time.

`final_states` folds machines with few states: what an event does is a map from states to states, maps compose, and so a
key's events are composed by slices of time first and then the slices; no key's events must fit into one row or task.
`streamed` is for folds whose state is no such map: a key's rows stream past one by one in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema


def _table(rows: list[list[int]]) -> Column:
    return F.array(*(F.array(*map(F.lit, r)) for r in rows))


def final_states(events: DataFrame, key: str, states: tuple[str, ...], moves: dict[str, dict[str, str]], errors: dict[str, tuple[str, ...]], slice_by: str = "day") -> DataFrame:
    """key, status, changes and errors of each key of events (key, at, event_id, move), which begins in states[0].

    A move takes a state where moves says so and leaves others as they are; errors counts moves made in a state in which
    they are refused. Unknown or null moves do nothing; events of a null key are a key's; an empty log gives no rows.
    """
    names, n = list(moves), len(states)
    to = _table([[states.index(moves[m].get(s, s)) for s in states] for m in names])
    bad = _table([[int(s in errors.get(m, ())) for s in states] for m in names])
    code = F.lit(None).cast("int")
    for k, m in enumerate(names):
        code = F.when(F.col("move") == m, k).otherwise(code)
    stay = F.array(*(F.struct(F.lit(k).alias("to"), F.lit(0).cast("long").alias("changes"), F.lit(0).cast("long").alias("errors")) for k in range(n)))

    def one(acc: Column, e: Column) -> Column:
        go = lambda x: to[e["code"]][x["to"]]
        return F.transform(acc, lambda x: F.struct(go(x).alias("to"), (x["changes"] + (go(x) != x["to"]).cast("long")).alias("changes"), (x["errors"] + bad[e["code"]][x["to"]]).alias("errors")))

    def both(acc: Column, e: Column) -> Column:
        then = lambda x: e["m"][x["to"]]
        return F.transform(acc, lambda x: F.struct(then(x)["to"].alias("to"), (x["changes"] + then(x)["changes"]).alias("changes"), (x["errors"] + then(x)["errors"]).alias("errors")))

    coded = events.select(key, F.date_trunc(slice_by, "at").alias("slice"), "at", "event_id", code.alias("code"))
    in_order = F.filter(F.array_sort(F.collect_list(F.struct("at", "event_id", "code"))), lambda e: e["code"].isNotNull())
    slices = coded.groupBy(key, "slice").agg(in_order.alias("events")).select(key, "slice", F.aggregate("events", stay, one).alias("m"))
    ends = slices.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("slice", "m"))).alias("slices")).select(key, F.aggregate("slices", stay, both)[0].alias("end"))
    return ends.select(key, F.array(*map(F.lit, states))[F.col("end.to")].alias("status"), "end.changes", "end.errors")


def streamed(rows: DataFrame, key: str, order: list[str], start: Callable[[], dict], step: Callable[[dict, dict], dict], schema: str) -> DataFrame:
    """What step(state, row) returns for each row of a key in order, beginning with start(). A key's rows pass through one
    task, since each outcome depends on those before, but they are never held: memory is that of the state."""
    spark = rows.sparkSession
    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = object(), {}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row[key] != at:
                    at, state = row[key], start()
                out.append(step(state, row))
            yield pa.RecordBatch.from_pylist(out, arrow)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
