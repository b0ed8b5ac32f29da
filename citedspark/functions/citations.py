"""Citation records: one nullable struct with a kind, its rendering and its checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citedspark.fixed_values import CITATION_FIELDS, COHORT_TABLE

FIELDS = tuple(dict.fromkeys(name for names in CITATION_FIELDS.values() for name in names))


def citation(kind: str, **values: Column) -> Column:
    """A citation of one kind; a value that is NULL becomes blank."""
    wanted = CITATION_FIELDS[kind]
    return F.struct(
        F.lit(kind).alias("kind"),
        *[
            (F.coalesce(values[name].cast("string"), F.lit("")) if name in wanted else F.lit(None).cast("string"))
            .alias(name)
            for name in FIELDS
        ],
    )


def _per_kind(record: Column, build) -> Column:
    result = None
    for kind, names in CITATION_FIELDS.items():
        hit = record["kind"] == kind
        value = build(kind, names)
        result = F.when(hit, value) if result is None else result.when(hit, value)
    return result


def rendered(record: Column) -> Column:
    """(field=value, ...) in the fixed order of the kind."""

    def build(_kind: str, names: tuple[str, ...]) -> Column:
        parts = [F.concat(F.lit(f"{name}="), F.coalesce(record[name], F.lit(""))) for name in names]
        return F.concat(F.lit("("), F.concat_ws(", ", *parts), F.lit(")"))

    return _per_kind(record, build)


def rendered_kind(kind: str, **values: Column) -> Column:
    """The rendering of one kind straight from columns."""
    parts = [
        F.concat(F.lit(f"{name}="), F.coalesce(values[name].cast("string"), F.lit("")))
        for name in CITATION_FIELDS[kind]
    ]
    return F.concat(F.lit("("), F.concat_ws(", ", *parts), F.lit(")"))


def problems(record: Column) -> Column:
    """What is wrong with a citation; an empty array when nothing is."""

    def blank(name: str) -> Column:
        return F.trim(F.coalesce(record[name], F.lit(""))) == ""

    def build(kind: str, names: tuple[str, ...]) -> Column:
        missing = [F.when(blank(name), F.lit(name)) for name in names]
        if kind == "document":
            reasons = [
                F.when(
                    blank(name),
                    F.lit(
                        "document_id is required because element ids restart across files"
                        if name == "document_id"
                        else f"{name} is required"
                    ),
                )
                for name in names
            ]
            return F.array_compact(F.array(*reasons))
        if kind == "cohort":
            missing.append(
                F.when(
                    F.coalesce(record["table"], F.lit("")) != COHORT_TABLE,
                    F.lit(f"cohort citation table must be {COHORT_TABLE}"),
                )
            )
        listed = F.array_join(F.array_compact(F.array(*missing)), ", ")
        reason = F.when(listed != "", F.concat(F.lit(f"{kind} citation missing "), listed))
        if kind == "table":
            reason = F.when(
                record["table"] == COHORT_TABLE, F.lit(f"{COHORT_TABLE} uses a cohort citation")
            ).otherwise(reason)
        return F.array_compact(F.array(reason))

    return _per_kind(record, build)
