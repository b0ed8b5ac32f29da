"""How messages and lines are put together from columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citedspark.functions.columns import tidy


def filled(template: str, **values: Column) -> Column:
    """A message with its {names} replaced by columns."""
    parts: list[Column] = []
    for index, piece in enumerate(template.replace("}", "{").split("{")):
        parts.append(values[piece].cast("string") if index % 2 else F.lit(piece))
    return F.concat(*parts)


def said(value: Column, otherwise: str) -> Column:
    return F.coalesce(tidy(value), F.lit(otherwise))


def blank(value: Column) -> Column:
    return F.coalesce(tidy(value), F.lit("")) == ""


def sentence(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(part) if isinstance(part, str) else part for part in parts])
