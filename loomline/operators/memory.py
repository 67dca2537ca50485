"""Scores of memories: at first, with age and use, and what is promoted or pruned."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bounded(x: Column) -> Column:
    """Between 0 and 1; 0 if not finite."""
    finite = ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(F.coalesce(finite, F.lit(False)), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))).otherwise(0.0)


def initial_score(relevance: Column, novelty: Column, confidence: Column) -> Column:
    return bounded(0.45 * relevance + 0.30 * novelty + 0.25 * confidence)


def current_score(initial: Column, accesses: Column, age: Column, relevance: Column) -> Column:
    return bounded(initial * (1 + F.log1p(accesses)) / (1 + F.log1p(age) * F.greatest(F.lit(0.1), relevance)))


def lifecycle(score: Column, confidence: Column, accesses: Column, age: Column) -> Column:
    """Prune comes first, then promote, then active from 0.20 on."""
    return F.when((score <= 0.05) & (accesses == 0) & (age > 1), "prune").when((score >= 0.75) & (confidence >= 0.70), "promote").when(score >= 0.20, "active").otherwise("inactive")
