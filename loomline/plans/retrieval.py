"""Queries of retrieval and composition."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.functions import expr
from loomline.operators import rag
from loomline.registry import query
from loomline.sources import tables
from loomline.sources.tables import ITEMS

_SCORE = "score DESC NULLS LAST, coalesce(provider, ''), source_type, coalesce(id, '')"
_UNION = "coalesce(provider, ''), source_type, coalesce(id, '')"


def _merged(spark, sf_dir, dedup, mode):
    """One batch for each content type, so that numbers are dense within a batch and no task gets all items."""
    items = rag.deduplicate(tables.rag_items(spark, sf_dir), dedup)
    return rag.renumber(items, ["content_type"], rag.order_by(mode)).select("content_type", "provider", "id", "score", "stable_order")


@query("rag_merge_dedup_rank", f"""WITH {ITEMS}, best AS (SELECT *, row_number() OVER (PARTITION BY provider, id ORDER BY {_SCORE}) AS p FROM items)
  SELECT content_type, provider, id, score, (row_number() OVER (PARTITION BY content_type ORDER BY {_SCORE}) - 1)::INT AS stable_order FROM best WHERE p = 1""")
def merge_dedup_rank(spark, sf_dir):
    return _merged(spark, sf_dir, "BySourceAndId", "DeterministicScoreThenId")


@query("rag_merge_by_id", f"""WITH {ITEMS}, best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {_SCORE}) AS p FROM items)
  SELECT content_type, provider, id, score, (row_number() OVER (PARTITION BY content_type ORDER BY {_SCORE}) - 1)::INT AS stable_order FROM best WHERE p = 1""")
def merge_by_id(spark, sf_dir):
    return _merged(spark, sf_dir, "ById", "BestScoreWins")


@query("rag_union_order", f"WITH {ITEMS} SELECT content_type, provider, id, score, (row_number() OVER (PARTITION BY content_type ORDER BY {_UNION}) - 1)::INT AS stable_order FROM items")
def union_order(spark, sf_dir):
    return _merged(spark, sf_dir, "None", "StableUnion")


@query("rag_first_provider", f"""WITH {ITEMS}, f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY provider, id) AS p FROM items)
  SELECT content_type, provider, id, (row_number() OVER (PARTITION BY content_type ORDER BY coalesce(score, 0) DESC, id) - 1)::INT AS place FROM f WHERE p = 1""")
def first_provider(spark, sf_dir):
    items = rag.first_provider(tables.rag_items(spark, sf_dir))
    return rag.renumber(items, ["content_type"], [F.coalesce("score", F.lit(0.0)).desc(), F.col("id")], "place").select("content_type", "provider", "id", "place")


_FRAGMENTS = f"""{ITEMS}, numbered AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY {_UNION}) - 1 AS stable_order FROM items),
  fragments AS (SELECT provider, provider || ':' || id AS key, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS text,
    CASE WHEN provider_kind = 'Runtime' THEN 'Runtime' WHEN contains(lower(content_type), 'summary') THEN 'Summary' ELSE 'Fact' END AS kind,
    (row_number() OVER (PARTITION BY provider ORDER BY stable_order, provider, id) - 1)::INT AS fragment_order FROM numbered
    WHERE regexp_replace(content, '^\\s+|\\s+$', '', 'g') <> '')"""


def _fragments(spark, sf_dir):
    items = rag.renumber(tables.rag_items(spark, sf_dir), ["provider"], rag.order_by("StableUnion"))
    return rag.fragments(items, ["provider"])


@query("rag_fragments", f"WITH {_FRAGMENTS} SELECT provider, key, kind, fragment_order, sha256(text) AS text_sha256 FROM fragments")
def fragments(spark, sf_dir):
    return _fragments(spark, sf_dir).select("provider", "key", "kind", "fragment_order", F.sha2("text", 256).alias("text_sha256"))


# A conversation is a batch of its turns: composing whole providers would put a provider's whole text into one row.
@query("rag_compose_text", """SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS text, count(*) AS parts
  FROM conversations WHERE text IS NOT NULL GROUP BY conv_id""")
def compose_text(spark, sf_dir):
    turns = tables.table(spark, sf_dir, "conversations").filter("text is not null")
    return rag.composed(turns, ["conv_id"], "turn", "text")


@query("rag_compose_groups", """SELECT conv_id, role, string_agg(text, chr(10) ORDER BY turn, text) AS text, count(*) AS parts
  FROM conversations WHERE text IS NOT NULL GROUP BY conv_id, role""")
def compose_groups(spark, sf_dir):
    turns = tables.table(spark, sf_dir, "conversations").filter("text is not null")
    return rag.composed(turns, ["conv_id", "role"], "turn", "text", "\n")


@query("rag_diagnostics", f"""WITH {ITEMS} SELECT provider, count(*) AS raw_items, count(DISTINCT id) AS distinct_ids, count(score) AS scored,
  sum(CASE WHEN score > 0 THEN 1 ELSE 0 END)::BIGINT AS good, max(length(content))::BIGINT AS longest FROM items GROUP BY provider""")
def diagnostics(spark, sf_dir):
    items = tables.rag_items(spark, sf_dir)
    return items.groupBy("provider").agg(F.count("*").alias("raw_items"), F.count_distinct("id").alias("distinct_ids"), F.count("score").alias("scored"), F.count_if(F.col("score") > 0).alias("good"), F.max(F.length("content")).cast("long").alias("longest"))


@query("rag_row_text", """SELECT c_custkey, concat_ws(chr(10), 'c_custkey: ' || c_custkey, 'c_mktsegment: ' || nullif(c_mktsegment, 'BUILDING'), 'c_name: ' || c_name) AS content FROM customer""")
def row_text(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "customer").withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return rows.select("c_custkey", rag.row_text(["c_name", "c_mktsegment", "c_custkey"]).alias("content"))


@query("rag_operation_text", """SELECT c_custkey, 'c_name: ' || c_name || chr(10) || 'c_mktsegment: ' || coalesce(nullif(c_mktsegment, 'BUILDING'), '') AS content FROM customer""")
def operation_text(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "customer").withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return rows.select("c_custkey", rag.row_text(["c_name", "c_mktsegment"], keep_nulls=True).alias("content"))


@query("rag_normalise", """WITH n AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS p FROM customer)
  SELECT 'customer:' || c_nationkey || ':' || p AS id, p::INT AS stable_order, c_custkey FROM n""")
def normalise(spark, sf_dir):
    rows = rag.normalise(tables.table(spark, sf_dir, "customer"), "customer", "c_nationkey", ["c_nationkey"], ["c_custkey"])
    return rows.select("id", "stable_order", "c_custkey")


@query("rag_keyed_scan", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_custkey = 7")
def keyed_scan(spark, sf_dir):
    return tables.keyed_scan(tables.table(spark, sf_dir, "orders"), "o_custkey", 7).select("o_orderkey", "o_totalprice", "o_orderstatus")


@query("rag_missing_sources", "SELECT DISTINCT lang AS step_name FROM documents WHERE lang NOT IN (SELECT lang FROM documents WHERE source = 'src1')")
def missing_sources(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents").select(F.col("lang").alias("step_name"), "source")
    return rag.missing_sources(docs.select("step_name").distinct(), docs.filter("source = 'src1'"))


@query("rag_ordered_columns", "SELECT n_name, n_nationkey, n_regionkey FROM nation")
def ordered_columns(spark, sf_dir):
    return tables.ordered_columns(tables.table(spark, sf_dir, "nation"))


@query("rag_rehydrate", """SELECT event_id, (props->>'$.k')::INT AS k, CASE WHEN (props->>'$.k')::INT >= 80 THEN 'shortlist' WHEN (props->>'$.k')::INT <= 50 THEN 'reject' ELSE 'review' END AS decision FROM events""")
def rehydrate(spark, sf_dir):
    """Untyped JSON to typed columns, and a decision on a score in it."""
    e = tables.table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k int"))
    return e.select("event_id", F.col("p.k").alias("k"), expr.decision(F.col("p.k")).alias("decision"))


@query("expr_template", """SELECT event_id, replace(replace('Event {{type}} of {{user}}: {{none}}', '{{type}}', event_type), '{{user}}', user_id::VARCHAR) AS text FROM events""")
def template(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events")
    return e.select("event_id", expr.render(F.lit("Event {{type}} of {{user}}: {{none}}"), {"type": F.col("event_type"), "user": F.col("user_id")}).alias("text"))


@query("expr_fingerprint", "SELECT item_id, upper(sha256(text)) AS fingerprint FROM benchmark")
def fingerprint(spark, sf_dir):
    return tables.table(spark, sf_dir, "benchmark").select("item_id", expr.fingerprint(F.col("text")).alias("fingerprint"))


@query("expr_path", "SELECT event_id, props->>'$.k' AS k, props->>'$.missing' AS missing FROM events")
def path(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events")
    return e.select("event_id", expr.at_path(F.col("props"), "k").alias("k"), expr.at_path(F.col("props"), "missing").alias("missing"))


@query("expr_inline", "SELECT page_id, length(html)::INT AS chars, length(html) <= 2048 AS is_inline FROM pages")
def inline(spark, sf_dir):
    """Whether a payload is stored in its row or as an artifact."""
    return tables.table(spark, sf_dir, "pages").select("page_id", F.length("html").alias("chars"), expr.is_inline(F.col("html")).alias("is_inline"))


@query("expr_setting", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END, CASE WHEN o_custkey % 2 = 0 THEN 100.0::DOUBLE END, 5.0::DOUBLE) AS setting FROM orders")
def setting(spark, sf_dir):
    o = tables.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", expr.setting(F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")), F.when(F.col("o_custkey") % 2 == 0, 100.0), F.lit(5.0)).alias("setting"))


@query("expr_coercion", """SELECT event_id, CASE WHEN lower(event_type) = 'click' THEN 'click' WHEN lower(event_type) = 'view' THEN 'view' END AS by_name,
  CASE (props->>'$.k')::INT WHEN 0 THEN 'click' WHEN 1 THEN 'view' END AS by_number FROM events""")
def coercion(spark, sf_dir):
    e, names = tables.table(spark, sf_dir, "events"), ["click", "view"]
    return e.select("event_id", expr.as_enum(F.upper("event_type"), names).alias("by_name"), expr.as_enum(F.get_json_object("props", "$.k"), names).alias("by_number"))
