"""Queries over streams, run on what is there."""

from __future__ import annotations

from loomline.registry import query
from loomline.sources import shared
from loomline.streaming import ledger


# Numbers follow arrival, so which entry gets which isn't fixed; that they are dense is tested.
@query("stream_ledger_sequence")
def ledger_sequence(spark, sf_dir):
    folder = shared.folder(spark, "stream")
    return ledger.to_files(ledger.numbered(ledger.event_stream(spark, sf_dir)), f"{folder}/rows", f"{folder}/state")


# In append mode a window comes out when the watermark has passed it, so the last ones stay in the state.
@query("stream_windowed_counts", """WITH last AS (SELECT max(ts) - INTERVAL 2 HOUR AS mark FROM events)
  SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, last
  WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= mark GROUP BY ALL""")
def windowed_counts(spark, sf_dir):
    folder = shared.folder(spark, "stream")
    return ledger.to_files(ledger.windowed_counts(ledger.event_stream(spark, sf_dir)), f"{folder}/rows", f"{folder}/state")
