"""Scalar column expressions: numbers, dates, blanks and row normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citedspark.fixed_values import ALIASES, BLANK_WORDS


def up(column: Column | str) -> Column:
    """Ascending, blanks last."""
    return (F.col(column) if isinstance(column, str) else column).asc_nulls_last()


def down(column: Column | str) -> Column:
    """Descending, blanks first."""
    return (F.col(column) if isinstance(column, str) else column).desc_nulls_first()


def blank_to_null(column: Column) -> Column:
    return F.nullif(column, F.lit(""))


def whole_number(text: Column) -> Column:
    """Mixed text to a whole number: '5.8' rounds to 6 and words give NULL."""
    return text.try_cast("decimal(38,0)")


def scaled_number(text: Column, scale: int = 4) -> Column:
    return text.try_cast(f"decimal(18,{scale})")


def as_timestamp(date: Column) -> Column:
    return date.cast("timestamp_ntz")


def completed_years(born: Column, at: Column) -> Column:
    """Whole years between two dates; 29 February counts from 28 February."""
    years = F.year(at) - F.year(born)
    anniversary = F.add_months(born, years * 12)
    return years - F.when(anniversary > at, 1).otherwise(0)


def open_at(stop: Column, at: Column) -> Column:
    """A span with no end, or one that ends on or after the date."""
    return stop.isNull() | (stop >= at)


def rate_percent(part: Column, whole: Column) -> Column:
    """Percent with two decimals, NULL when there is nothing to divide by."""
    return F.round(
        F.lit(100).cast("decimal(5,1)") * part.cast("decimal(18,0)")
        / F.nullif(whole.cast("decimal(18,0)"), F.lit(0).cast("decimal(18,0)")),
        2,
    ).cast("decimal(7,2)")


def tidy(value: Column) -> Column:
    """Stripped text; blanks and the words none, nan and null become NULL."""
    words = [word for word in BLANK_WORDS if word]
    text = value.cast("string")
    stripped = F.regexp_replace(text, rf"(?iU)^\s*({'|'.join(words)})?\s*$|^\s+|\s+$", "")
    # Text with a printable ASCII sign at both ends has nothing to strip, and needs no pattern.
    plain = F.ascii(text).between(33, 126) & F.ascii(F.right(text, F.lit(1))).between(33, 126)
    return F.when(plain & ~F.lower(text).isin(words), text).otherwise(F.nullif(stripped, F.lit("")))


def normalised_rows(df: DataFrame, extra_aliases: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Lower-case names, tidy every value, fill each citation field from its aliases."""
    present = {name.lower(): name for name in df.columns}
    tidied = {low: tidy(F.col(f"`{name}`")) for low, name in present.items()}
    for target, names in {**ALIASES, **(extra_aliases or {})}.items():
        sources = [target, *names]
        found = [tidy(F.col(f"`{present[name]}`")) for name in dict.fromkeys(sources) if name in present]
        if found:
            tidied[target] = F.coalesce(*found)
    return df.select(*[value.alias(name) for name, value in tidied.items()])


def day_matches(date: Column, day: Column) -> Column:
    """The date's text starts with the given day text; metacharacters have no meaning."""
    return F.date_format(date, "yyyy-MM-dd").startswith(day)
