"""Scalar functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the longest JSON that is kept inline, in characters.
INLINE_CHARS = 2048


def render(template: Column, values: dict[str, Column]) -> Column:
    """Each {{name}} replaced one variable after another, so a value's own placeholders are replaced by later ones."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{{" + name + "}}"), F.coalesce(value.cast("string"), F.lit("")))
    return template


def fingerprint(text: Column) -> Column:
    return F.upper(F.sha2(text, 256))


def at_path(json: Column, path: str) -> Column:
    """A dotted path into a JSON text."""
    return F.get_json_object(json, "$." + path)


def decision(score: Column, shortlist: float = 80, reject: float = 50) -> Column:
    if reject > shortlist:
        raise ValueError("reject lies above shortlist")
    return F.when(score >= shortlist, "shortlist").when(score <= reject, "reject").otherwise("review")


def is_inline(text: Column, limit: int = INLINE_CHARS) -> Column:
    return F.length(text) <= limit


def setting(*levels: Column) -> Column:
    """A step's value, else the pipeline's, else the default."""
    return F.coalesce(*levels)


def first_filled(*columns: str) -> Column:
    return F.coalesce(*(F.nullif(F.trim(F.col(c)), F.lit("")) for c in columns))


def canonical(text: Column) -> Column:
    return F.lower(F.trim(text))


def as_enum(value: Column, names: list[str]) -> Column:
    """A name in any case, or its number, as the name; null if neither."""
    by_name = F.coalesce(*(F.when(F.lower(F.trim(value)) == n.lower(), n) for n in names))
    number = F.expr("try_cast(NULL as int)") if not names else value.try_cast("int")
    return F.coalesce(by_name, F.when((number >= 0) & (number < len(names)), F.element_at(F.array(*map(F.lit, names)), number + 1)))
