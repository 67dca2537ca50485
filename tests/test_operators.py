"""Operators on small tables made by hand: ties, nulls, empty tables, limits."""

import random
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from loomline import plans, registry  # noqa: F401
from loomline.functions import expr
from loomline.operators import control, dag, memory, observe, ordered, policy, rag
from loomline.sources import tables

ITEM = "provider string, source_type int, id string, provider_kind string, content_type string, content string, score double"


def items(spark, rows):
    return spark.createDataFrame([(p, s, i, "Relational", "x", c, v) for p, s, i, c, v in rows], ITEM)


def test_deduplicate_keeps_the_best_score_and_then_the_lowest_provider(spark):
    df = items(spark, [("b", 2, "1", "t", 1.0), ("a", 2, "1", "t", 1.0), ("a", 2, "2", "t", None), ("c", 2, "2", "t", -5.0), (None, 2, "3", "t", None)])
    got = {(r.provider, r.id) for r in rag.deduplicate(df, "ById").collect()}
    assert got == {("a", "1"), ("c", "2"), (None, "3")}
    assert rag.deduplicate(df, "BySourceAndId").count() == 5
    assert {(r.provider, r.id) for r in rag.first_provider(df.filter("provider is not null")).collect()} == {("a", "1"), ("a", "2")}


def test_source_types_order_by_number(spark):
    df = items(spark, [("a", 1000, "1", "t", None), ("a", 2, "2", "t", None)])
    got = rag.renumber(df, ["content_type"], rag.order_by("Concat")).orderBy("stable_order").collect()
    assert [(r.id, r.stable_order) for r in got] == [("2", 0), ("1", 1)]


def test_blank_texts_make_no_fragment_and_leave_no_gap(spark):
    df = rag.renumber(items(spark, [("a", 2, "1", "  x ", None), ("a", 2, "2", " \n", None), ("a", 2, "3", "y", None)]), ["provider"], rag.order_by("None"))
    got = rag.fragments(df, ["provider"]).orderBy("fragment_order").collect()
    assert [(r.key, r.text, r.fragment_order) for r in got] == [("a:1", "x", 0), ("a:3", "y", 1)]


STEP = "execution_id long, step_no int, status string, has_retry_state boolean, next_retry_at timestamp_ntz, lease_expires_at timestamp_ntz"
NOW = datetime(2024, 1, 2)


def state(spark, rows):
    steps = spark.createDataFrame([(1, n, s, True, None, lease) for n, s, lease in rows], STEP)
    return spark.createDataFrame([(1,), (2,)], "execution_id long"), steps, tables.edges(steps), F.lit(NOW).cast("timestamp_ntz")


def converged(spark, rows):
    return {r.execution_id: r.convergence for r in dag.convergence(*state(spark, rows)).collect()}


def test_convergence(spark):
    later, before = NOW + timedelta(1), NOW - timedelta(1)
    assert converged(spark, [(1, "Completed", None)]) == {1: "Completed", 2: "Waiting"}
    assert converged(spark, [(1, "Failed", None), (2, "None", None)])[1] == "Failed"
    # A step under one that has failed can't progress, but the one below it sees only a parent without status.
    assert converged(spark, [(1, "Failed", None), (2, "None", None), (3, "None", None)])[1] == "Waiting"
    assert converged(spark, [(1, "Running", later)])[1] == "Running"
    assert converged(spark, [(1, "Running", before)])[1] == "Waiting"


def test_a_wait_without_time_is_due_and_one_without_state_never(spark):
    df = spark.createDataFrame([(1, 1, "WaitingForRetry", True, None, None), (1, 2, "WaitingForRetry", False, None, None)], STEP)
    assert [r.step_no for r in df.filter(dag.claimable(F.lit(NOW).cast("timestamp_ntz"))).collect()] == [1]


def test_cycles(spark, tmp_path):
    df = spark.createDataFrame([(1, "b", "a"), (1, "c", "b"), (1, "b", "c"), (1, "d", "c"), (2, "b", "a"), (2, "c", "b")], "g int, child string, parent string")
    assert {(r.g, r.node) for r in dag.cyclic(df, "g", f"file://{tmp_path}").collect()} == {(1, "b"), (1, "c"), (1, "d")}
    assert dag.cyclic(df.filter("g = 2"), "g", f"file://{tmp_path}/2").count() == 0


def test_definitions(spark):
    good = '{"pipelines":[{"name":"p","version":"1","executionMode":"Dag","steps":[{"name":"a","stepKey":"k","order":1},{"name":"b","stepKey":"k","order":2,"dependsOn":["a"]}]}]}'
    rows = tables.pipeline_definitions(spark.createDataFrame([(good,), ("[]",)], "value string")).orderBy("step_order").collect()
    assert [(r.step_name, r.depends_on) for r in rows] == [("a", []), ("b", ["a"])]
    with pytest.raises(Exception, match="no pipelines"):
        tables.pipeline_definitions(spark.createDataFrame([('{"other": 1}',)], "value string")).collect()


def test_backoff(spark):
    rows = spark.createDataFrame([("Exponential", 3), ("Linear", 3), ("Fixed", 0), ("exponential", 30)], "kind string, n int")
    got = rows.select(policy.backoff(F.col("kind"), F.lit(100), F.col("n"), F.lit(5000)).alias("ms")).collect()
    assert [r.ms for r in got] == [800.0, 100.0, 100.0, 5000.0]


def test_at_most_ten_oldest_are_evicted(spark):
    rows = [(1, f"s{k:02}", "Completed", datetime(2024, 1, 1 + k % 5), False) for k in range(30)] + [(2, "x", "Completed", None, False)]
    df = spark.createDataFrame(rows, "execution_id long, step_name string, status string, completed_at timestamp_ntz, is_evicted boolean")
    got = policy.eviction_candidates(df, 5).collect()
    assert len(got) == 10 and {r.completed_at.day for r in got} == {1, 2}


def test_leases(spark):
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    rows = [("a", at(0), 1, 10_000), ("a", at(1), 2, 10_000), ("a", at(2), 3, 10_000), ("a", at(3), 1, 10_000), ("a", at(11), 4, 1000), ("b", at(2), 3, 1)]
    df = spark.createDataFrame(rows, "scope string, at timestamp_ntz, lease_id long, lease_ms long")
    got = policy.lease_semaphore(df, 2).orderBy("scope", "at").collect()
    assert [(r.granted, r.retry_after_ms) for r in got] == [(True, None), (True, None), (False, 8000), (True, None), (True, None), (True, None)]
    assert policy.lease_semaphore(df.limit(0), 2).count() == 0


def test_histogram_keeps_empty_buckets_and_upper_bounds(spark):
    df = spark.createDataFrame([(1.0,), (1.5,), (99.0,)], "v double")
    assert [r.n for r in observe.histogram(df, "v", [1.0, 2.0, 3.0]).orderBy("bucket").collect()] == [1, 1, 0, 1]


def test_nearest_rank(spark):
    df = spark.createDataFrame([("a", float(k)) for k in range(1, 11)], "g string, v double")
    assert observe.percentiles(df, ["g"], "v", {"p50": 0.5, "p95": 0.95}).first()[1:] == (5.0, 10.0)


def test_permissions(spark):
    grants = spark.createDataFrame([("trn:p:n:r:f:read",), ("trn:q:n:*:*:read",), ("trn:s:n:r*:f:read",), ("bad",)], "trn string")
    rows = [(1, "P", "n", "r", "f", "READ"), (2, "q", "n", "x", "y", "read"), (3, "q", "n", "x", "y", "write"), (4, "s", "n", "rx", "f", "read")]
    got = control.granted(grants, spark.createDataFrame(rows, "request_id int, project string, ns string, resource string, feature string, action string")).collect()
    assert {r.request_id: r.allowed for r in got} == {1: True, 2: True, 3: False, 4: False}


def test_memories(spark):
    score = memory.current_score(F.col("i"), F.col("n"), F.col("a"), F.col("r"))
    got = spark.createDataFrame([(0.5, 0, 0, 0.5), (float("nan"), 0, 0, 0.5), (0.9, 50, 0, 0.5)], "i double, n int, a int, r double").select(score.alias("s")).collect()
    assert [r.s for r in got] == [0.5, 0.0, 1.0]


def test_templates_replace_one_after_another(spark):
    df = spark.range(1).select(expr.render(F.lit("{{a}}-{{c}}"), {"a": F.lit("{{b}}"), "b": F.lit("x")}).alias("t"))
    assert df.first().t == "x-{{c}}"
    with pytest.raises(ValueError):
        expr.decision(F.lit(1), 10, 20)


def test_running_totals_equal_a_window_over_the_whole_batch(spark):
    rows = [("a" if k % 3 else None, (k * 7919) % 1000, k % 5) for k in range(5000)] + [(f"b{k}", k, 1) for k in range(40)]
    df = spark.createDataFrame(rows, "g string, at int, w int").repartition(7)
    got = ordered.running(df, ["g"], [F.col("at"), F.col("w")], "n")
    assert sorted(r.n for r in got.filter("g is null").collect()) == list(range(1, 1668))
    assert {r.n for r in got.filter("g like 'b%'").collect()} == {1}
    placed = [(r.at, r.w) for r in got.filter("g = 'a'").orderBy("n").collect()]
    assert placed == sorted((at, w) for g, at, w in rows if g == "a")
    summed = ordered.running(df.groupBy("g", "at").agg(F.sum("w").alias("w")), ["g"], [F.desc("at")], "total", "w").filter("g = 'a'").collect()
    assert all(r.total == sum(w for g, at, w in rows if g == "a" and at >= r.at) for r in summed[::50])
    assert ordered.running(df.limit(0), ["g"], [F.col("at")], "n").count() == 0


def test_percentiles_of_nulls_ties_and_null_keys(spark):
    df = spark.createDataFrame([("a", None), ("a", 2.0), ("a", 2.0), ("a", 1.0), (None, 5.0), ("z", None)], "g string, v double")
    got = {r.g: (r.p50, r.p0) for r in observe.percentiles(df, ["g"], "v", {"p50": 0.5, "p0": 0.0}).collect()}
    assert got == {"a": (2.0, 1.0), None: (5.0, 5.0), "z": (None, None)}


def test_leases_over_several_scopes_equal_a_plain_fold(spark):
    rng, base = random.Random(5), datetime(2024, 1, 1)
    rows = []
    for k in range(1500):
        scopes = [(name, cap) for name, cap in (("all", 5), (f"p{rng.randrange(3)}", 2), ("open", None)) if rng.random() < 0.9]
        rows.append((rng.choice(["a", "a", "b", None]), base + timedelta(seconds=rng.randrange(400)), k, rng.choice(["acquire", "acquire", "release"]), rng.randrange(12), rng.randrange(1, 60_000), scopes))
    df = spark.createDataFrame(rows, "root string, at timestamp_ntz, seq long, action string, lease_id long, lease_ms long, scopes array<struct<name:string,cap:int>>")
    grants, want = [], {}
    for root, at, seq, action, lease, ms, scopes in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        if action == "release":
            grants = [g for g in grants if not (g[0] == root and g[2] == lease and g[1] in dict(scopes))]
            want[seq] = (None, None)
            continue
        capped = [(n, c) for n, c in scopes if c]
        live = lambda n: [g for g in grants if g[0] == root and g[1] == n and g[3] > at]  # noqa: B023, E731
        full = [n for n, c in capped if lease not in {g[2] for g in live(n)} and len(live(n)) >= c]
        if not full:
            grants = [g for g in grants if not (g[0] == root and g[2] == lease and g[1] in dict(capped))] + [(root, n, lease, at + timedelta(milliseconds=ms)) for n, _ in capped]
        want[seq] = (not full, full[0] if full else None)
    got = {r.seq: (r.granted, r.blocked) for r in policy.lease_admission(df).collect()}
    assert got == want and {g for g, _ in want.values()} == {True, False, None}
    assert policy.lease_admission(df.limit(0)).count() == 0


def test_states_of_control_with_nulls_and_unknown_actions(spark):
    at = lambda d: datetime(2024, 1, d)
    rows = [("a", at(1), 1, "wait", "x"), ("a", at(2), 2, "input", "y"), ("a", at(2), 3, "input", "x"), ("a", at(3), 4, None, None), ("a", at(3), 5, "mark_running", None), (None, at(1), 6, "input", "x"), ("c", at(1), 8, "pause", None), ("c", at(1), 7, "cancel", None), ("c", at(2), 9, "input", "z"), ("d", at(1), 10, "nonsense", None)]
    df = spark.createDataFrame(rows, "k string, at timestamp_ntz, event_id long, action string, input_key string")
    got = {r.k: (r.status, r.changes, r.errors) for r in control.control_states(df, "k").collect()}
    assert got == {"a": ("Running", 3, 1), None: ("Running", 0, 1), "c": ("Cancelling", 1, 0), "d": ("Running", 0, 0)}
    assert control.control_states(df.limit(0), "k").count() == 0


HELPER_TABLES = ("l_orderkey long, l_suppkey long, l_returnflag string, l_linestatus string", "s_suppkey long, s_nationkey int")


def test_helpers_take_the_first_candidates_that_they_dont_hold_as_in_sql(spark, tmp_path):
    rng = random.Random(7)
    key = lambda n: rng.choice([None, *range(n)]) if rng.random() < 0.1 else rng.randrange(n)
    items = [(key(60), key(45) if rng.random() < 0.7 else 21, rng.choice("ANR"), rng.choice("OF")) for _ in range(2500)]
    # A zone with a null candidate among few, a helper that holds all of its zone, one without a candidate, negative keys.
    items += [(None, 117, "A", "F"), (5, 117, "A", "F"), (5, 138, "A", "O"), (6, 138, "A", "O"), (7, 178, "A", "F"), (1, -3, "A", "O"), (2, -3, "A", "F")]
    suppliers = [(k, k % 5) for k in range(45)] + [(117, 0), (138, 1), (158, 1), (179, 2), (-3, 2), (-23, 2), (None, 0), (57, None)] + [(21, 1), (21, 1), (31, 1), (31, 1), (31, 1)]
    for name, rows, schema in zip(("lineitem", "supplier"), (items, suppliers), HELPER_TABLES, strict=True):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for name in ("lineitem", "supplier"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for sf in (str(tmp_path), "/root/testdata/sf0.01"):
        if sf != str(tmp_path):
            con.execute(f"CREATE OR REPLACE VIEW lineitem AS SELECT * FROM '{sf}/lineitem.parquet'; CREATE OR REPLACE VIEW supplier AS SELECT * FROM '{sf}/supplier.parquet'")
        want = sorted(con.sql(registry.ORACLE["control_helper_match"]).fetchall(), key=str)
        got = registry.QUERIES["control_helper_match"](spark, sf).select("helper", "execution_id").collect()
        assert sorted(map(tuple, got), key=str) == want and len(want) > 20
    assert control.first_unheld(*(spark.createDataFrame([], s) for s in ("execution_id long, zone long", "helper long, zone long", "execution_id long, helper long")), 3).count() == 0


def test_helpers_are_not_paired_with_all_candidates_of_their_zone(spark, tmp_path):
    def shuffled():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteRecords() for k in range(stages.size())}

    # 300 helpers of one zone and 5,000 candidates: 1.5 million pairs, of 10,000 items.
    items = spark.range(10_000).select((F.col("id") % 5000).alias("l_orderkey"), (F.col("id") % 300 * 20).alias("l_suppkey"), F.lit("A").alias("l_returnflag"), F.lit("O").alias("l_linestatus"))
    items.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(300).select((F.col("id") * 20).alias("s_suppkey"), F.lit(0).alias("s_nationkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    before, most = set(shuffled()), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert registry.QUERIES["control_helper_match"](spark, str(tmp_path)).count() == 900
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    assert sum(n for k, n in shuffled().items() if k not in before) < 200_000
