import datetime

from loomline.streaming import ledger


def events(spark, folder, ids):
    at = datetime.datetime(2024, 1, 1)
    rows = [(i, at + datetime.timedelta(minutes=i), i % 3, "view", 1.0, "{}") for i in ids]
    spark.createDataFrame(rows, ledger.EVENTS).coalesce(1).write.mode("append").parquet(folder)


def test_numbers_continue_after_a_restart(spark, tmp_path):
    folder, out, state = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state"))
    for part in (range(10), range(10, 31)):
        events(spark, folder, part)
        rows = ledger.numbered(ledger.event_stream(spark, folder, "*.parquet", 1))
        got = ledger.to_files(rows, out, state).collect()
        by = {}
        for r in got:
            by.setdefault(r.execution_id, []).append(r.sequence)
        assert {k: sorted(v) for k, v in by.items()} == {k: list(range(1, 1 + sum(i % 3 == k for i in range(part.stop)))) for k in range(3)}


def test_every_sink_gets_every_row(spark, tmp_path):
    events(spark, f"file://{tmp_path}/in", range(20))
    got = [[], []]
    sinks = [lambda df, n, k=k: got[k].extend(r.entry_id for r in df.collect()) for k in range(2)]
    ledger.fan_out(ledger.event_stream(spark, f"file://{tmp_path}/in", "*.parquet"), sinks, f"file://{tmp_path}/state")
    assert sorted(got[0]) == sorted(got[1]) == list(range(20))
