"""Retrieval: normalise rows to items, unite, deduplicate, rank, renumber, and compose text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.operators import ordered

#: Orders by name; modes that behave alike share one.
UNION_ORDER, SCORE_ORDER = "union", "score"
ORDERS = {"Concat": UNION_ORDER, "StableUnion": UNION_ORDER, "None": UNION_ORDER, "BestScoreWins": SCORE_ORDER, "ScoreDescending": SCORE_ORDER, "DeterministicScoreThenId": SCORE_ORDER}


def order_by(mode: str) -> list[Column]:
    """Sort keys of a mode: provider, source type by its number, id; behind the score (null lowest) where scores rank."""
    keys = [F.coalesce("provider", F.lit("")), F.col("source_type"), F.coalesce("id", F.lit(""))]
    return ([F.col("score").desc_nulls_last()] if ORDERS[mode] == SCORE_ORDER else []) + keys


def deduplicate(items: DataFrame, by: str) -> DataFrame:
    """One item for each id ("ById") or provider and id ("BySourceAndId"): the best by score order. "None": all."""
    if by == "None":
        return items
    keys = {"ById": ["id"], "BySourceAndId": ["provider", "id"]}[by]
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by("BestScoreWins")))
    return items.withColumn("place", best).filter("place = 1").drop("place")


def first_provider(items: DataFrame) -> DataFrame:
    """The other retrieval's rule: the lowest provider of each id, whatever the scores."""
    first = F.row_number().over(Window.partitionBy("id").orderBy("provider", "id"))
    return items.withColumn("place", first).filter("place = 1").drop("place")


def renumber(items: DataFrame, batch: list[str], keys: list[Column], name: str = "stable_order") -> DataFrame:
    """Dense numbers from 0 within each batch, however large; what name held before is replaced."""
    return ordered.running(items.drop(name), batch, keys, name).withColumn(name, (F.col(name) - 1).cast("int"))


def missing_sources(wanted: DataFrame, batches: DataFrame) -> DataFrame:
    """Source steps that a merge names and that hold no batch."""
    return wanted.join(batches.select("step_name").distinct(), "step_name", "left_anti")


def normalise(rows: DataFrame, entity: str, id_col: str, batch: list[str], order: list[str]) -> DataFrame:
    """Rows as items: id of entity, source and place, no score, the place as stable order."""
    place = F.row_number().over(Window.partitionBy(*batch).orderBy(*order)) - 1
    return rows.withColumn("stable_order", place).withColumn("id", F.concat_ws(":", F.lit(entity), F.col(id_col).cast("string"), F.col("stable_order").cast("string"))).withColumn("score", F.lit(None).cast("double"))


def row_text(columns: list[str], keep_nulls: bool = False) -> Column:
    """"name: value" lines in ordinal order of names; nulls are left out, or kept as empty values."""
    line = lambda c: F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) if keep_nulls else F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))
    return F.concat_ws("\n", *(line(c) for c in (columns if keep_nulls else sorted(columns))))


def fragment_kind() -> Column:
    return F.when(F.col("provider_kind") == "Runtime", "Runtime").when(F.lower("content_type").contains("summary"), "Summary").otherwise("Fact")


def fragments(items: DataFrame, batch: list[str]) -> DataFrame:
    """Trimmed, non-blank texts of items in stable order, numbered after blanks are gone."""
    text = F.regexp_replace("content", r"^\s+|\s+$", "")
    rows = items.withColumn("text", text).filter(F.col("text") != "")
    rows = rows.withColumn("key", F.concat_ws(":", "provider", "id")).withColumn("kind", fragment_kind())
    return renumber(rows, batch, [F.col("stable_order"), F.col("provider"), F.col("id")], "fragment_order")


def texts_in_order(order: str, text: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(text)))), lambda x: x[text])


def composed(parts: DataFrame, batch: list[str], order: str, text: str, separator: str = "\n\n") -> DataFrame:
    """One text for each batch: its parts in order, a blank line between them."""
    return parts.groupBy(*batch).agg(F.array_join(texts_in_order(order, text), separator).alias("text"), F.count("*").alias("parts"))
