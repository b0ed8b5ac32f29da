"""A metric layer: logical tables, links, facts, dimensions and metrics, asked by name."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Metric:
    """COUNT or SUM of one expression over one logical table."""

    table: str
    kind: str
    expression: str


@dataclass(frozen=True)
class Model:
    """`dimensions` and `facts` map a name to (logical table, expression)."""

    keys: Mapping[str, tuple[str, ...]]
    # child table -> {parent table: child column}; the parent's key is its single key column
    links: Mapping[str, Mapping[str, str]]
    dimensions: Mapping[str, tuple[str, str]]
    metrics: Mapping[str, Metric]
    facts: Mapping[str, tuple[str, str]] = field(default_factory=dict)
    synonyms: Mapping[str, str] = field(default_factory=dict)

    def named(self, word: str) -> str:
        """The model's own name for a table, dimension, fact or metric, or for a synonym of one."""
        low = word.lower()
        name = self.synonyms.get(low, low)
        if name in self.keys or name in self.dimensions or name in self.metrics or name in self.facts:
            return name
        raise KeyError(f"the model has nothing called {word}")

    def path(self, table: str, target: str) -> list[str] | None:
        """Tables from `table` to `target` along many-to-one links, the direct link first."""
        reached: list[list[str]] = [[table]]
        while reached:
            for path in reached:
                if path[-1] == target:
                    return path
            reached = [
                [*path, parent] for path in reached for parent in self.links.get(path[-1], {}) if parent not in path
            ]
        return None


def metric_query(
    model: Model,
    tables: Mapping[str, DataFrame],
    metrics: Sequence[str],
    dimensions: Sequence[str] = (),
    where: Column | None = None,
) -> DataFrame:
    """The metrics by the dimensions.

    Each metric is counted over its own table, on the link key first, so the join to the
    parents moves one row per key and no fan-out can occur. Metrics of different tables meet
    on their dimension values. `where` may use the names of the chosen dimensions.
    """
    dims = [model.named(name) for name in dimensions]
    wanted = {name: model.metrics[name] for name in map(model.named, metrics)}
    by_table: dict[str, dict[str, Metric]] = {}
    for name, metric in wanted.items():
        by_table.setdefault(metric.table, {})[name] = metric
    parts = [_of_table(model, tables, table, chosen, dims, where) for table, chosen in by_table.items()]
    if len(parts) == 1:
        return parts[0]
    if not dims:
        return reduce(lambda a, b: a.crossJoin(b), parts)

    def meet(left: DataFrame, right: DataFrame) -> DataFrame:
        other = right.withColumnsRenamed({name: f"_r_{name}" for name in dims})
        same = reduce(lambda a, b: a & b, [F.col(name).eqNullSafe(F.col(f"_r_{name}")) for name in dims])
        joined = left.join(other, same, "full")
        return joined.select(
            *[F.coalesce(name, f"_r_{name}").alias(name) for name in dims],
            *[name for name in joined.columns if name not in dims and not name.startswith("_r_")],
        )

    return reduce(meet, parts)


def _of_table(
    model: Model, tables: Mapping[str, DataFrame], table: str, metrics: Mapping[str, Metric], dims: list[str],
    where: Column | None,
) -> DataFrame:
    own = {name: model.dimensions[name][1] for name in dims if model.dimensions[name][0] == table}
    foreign: dict[str, list[str]] = {}
    for name in dims:
        home = model.dimensions[name][0]
        if home == table:
            continue
        path = model.path(table, home)
        if path is None:
            raise ValueError(f"{name} cannot be reached from {table}")
        for parent in path[1:]:
            foreign.setdefault(parent, [])
        foreign[home].append(name)
    first_steps = sorted({column for parent, column in model.links.get(table, {}).items() if parent in foreign})
    # Pre-aggregation on own dimensions and link columns.
    grouped = tables[table].groupBy(
        *[F.expr(expression).alias(name) for name, expression in own.items()],
        *[F.col(column).alias(f"_{table}_{column}") for column in first_steps],
    )
    df = grouped.agg(
        *[
            (F.count(F.expr(m.expression)) if m.kind == "count" else F.sum(F.expr(m.expression))).alias(name)
            for name, m in metrics.items()
        ]
    )
    joined: set[str] = {table}
    for name in dims:
        path = model.path(table, model.dimensions[name][0])
        for child, parent in zip(path, path[1:]):
            if parent in joined:
                continue
            column = model.links[child][parent]
            onward = {
                f"_{parent}_{c}": c for p, c in model.links.get(parent, {}).items() if p in foreign
            }
            right = tables[parent].select(
                F.col(model.keys[parent][0]).alias(f"_key_{parent}"),
                *[F.expr(model.dimensions[d][1]).alias(d) for d in foreign[parent]],
                *[F.col(c).alias(alias) for alias, c in onward.items()],
            )
            df = df.join(right, F.col(f"_{child}_{column}") == F.col(f"_key_{parent}"), "left")
            joined.add(parent)
    if where is not None:
        df = df.filter(where)
    return df.groupBy(*dims).agg(
        *[
            (F.coalesce(F.sum(name), F.lit(0)) if m.kind == "count" else F.sum(name)).alias(name)
            for name, m in metrics.items()
        ]
    )


# --- Fixed values: the member model -------------------------------------------
_CLINICAL = ("condition", "medication", "observation", "allergy")


def _prefixed(table: str, prefix: str, **columns: str) -> dict[str, tuple[str, str]]:
    return {f"{prefix}_{name}": (table, column) for name, column in columns.items()}


MEMBER_MODEL = Model(
    keys={
        "patient": ("patient_id",),
        "encounter": ("encounter_id",),
        "condition": ("patient_id", "encounter_id", "code", "start_date"),
        "medication": ("source_file_row_number",),
        "observation": ("source_file_row_number",),
        "claim": ("claim_id",),
        "claim_line": ("claim_line_id",),
        "coverage_span": ("source_file_row_number",),
        "document_section": ("document_id", "element_id"),
        "allergy": ("patient_id", "encounter_id", "code", "start_date"),
        "risk_cohort": ("patient_id",),
    },
    links={
        "encounter": {"patient": "patient_id"},
        **{table: {"patient": "patient_id", "encounter": "encounter_id"} for table in _CLINICAL},
        "claim": {"patient": "patient_id", "encounter": "appointment_id"},
        "claim_line": {"claim": "claim_id"},
        "coverage_span": {"patient": "patient_id"},
        "document_section": {"patient": "patient_id"},
        "risk_cohort": {"patient": "patient_id"},
    },
    facts={
        "base_encounter_cost": ("encounter", "base_encounter_cost"),
        "total_claim_cost": ("encounter", "total_claim_cost"),
        "total_cost": ("medication", "total_cost"),
        "line_amount": ("claim_line", "amount"),
        "event_flag": ("risk_cohort", "event_flag"),
    },
    dimensions={
        **{
            name: ("patient", name)
            for name in (
                "patient_id", "first_name", "last_name", "gender", "birthdate", "deathdate", "city", "state",
            )
        },
        "encounter_id": ("encounter", "encounter_id"),
        **_prefixed(
            "encounter", "encounter",
            patient_id="patient_id", start="start_ts", code="code", description="description",
        ),
        "encounter_class": ("encounter", "encounter_class"),
        **_prefixed("condition", "condition", code="code", description="description", start="start_date",
                    patient_id="patient_id", encounter_id="encounter_id"),
        **_prefixed("medication", "medication", code="code", description="description", start="start_ts",
                    patient_id="patient_id", encounter_id="encounter_id"),
        **_prefixed("observation", "observation", code="code", description="description", value="value_text",
                    time="observation_ts", category="category", patient_id="patient_id",
                    encounter_id="encounter_id"),
        "claim_id": ("claim", "claim_id"),
        **_prefixed("claim", "claim", patient_id="patient_id", appointment_id="appointment_id",
                    diagnosis_1="diagnosis_1", primary_payer_id="primary_payer_id"),
        "claim_line_id": ("claim_line", "claim_line_id"),
        **_prefixed("claim_line", "claim_line", claim_id="claim_id", procedure_code="procedure_code",
                    notes="notes"),
        **_prefixed("coverage_span", "coverage", member_id="member_id", patient_id="patient_id",
                    payer_id="payer_id", start="start_ts", end="end_ts"),
        **{
            name: ("document_section", name)
            for name in ("document_id", "element_id", "section_loinc", "section_title")
        },
        "section_text": ("document_section", "text"),
        "section_code": ("document_section", "code"),
        "document_patient_id": ("document_section", "patient_id"),
        **_prefixed("allergy", "allergy", code="code", description="description", start="start_date",
                    patient_id="patient_id", encounter_id="encounter_id"),
        "point_total": ("risk_cohort", "point_total"),
        "point_age_ge_65": ("risk_cohort", "point_age"),
        "point_prior_acute_encounter": ("risk_cohort", "point_prior_acute_encounter"),
        "point_active_conditions_ge_8": ("risk_cohort", "point_active_conditions"),
        "point_last_a1c_ge_6_5": ("risk_cohort", "point_last_value"),
        "age_years_at_index": ("risk_cohort", "age_years_at_index"),
        "risk_patient_id": ("risk_cohort", "patient_id"),
    },
    metrics={
        "member_count": Metric("patient", "count", "patient_id"),
        "encounter_count": Metric("encounter", "count", "encounter_id"),
        "claim_count": Metric("claim", "count", "claim_id"),
        "medication_row_count": Metric("medication", "count", "source_file_row_number"),
        "cohort_patient_count": Metric("risk_cohort", "count", "patient_id"),
        "acute_event_count": Metric("risk_cohort", "sum", "event_flag"),
    },
    synonyms={
        "member": "patient",
        "beneficiary": "patient",
        "member id": "patient_id",
        "beneficiary id": "patient_id",
        "rxnorm": "medication_code",
        "rxcui": "medication_code",
    },
)


def model_tables(core: Mapping[str, DataFrame], risk_cohort: DataFrame) -> dict[str, DataFrame]:
    """The member model's logical tables over the conformed views."""
    tables = {name: core[name] for name in MEMBER_MODEL.keys if name in core}
    return {**tables, "coverage_span": core["payer_transition"], "risk_cohort": risk_cohort}


def fact_rows(
    model: Model, tables: Mapping[str, DataFrame], facts: Sequence[str], dimensions: Sequence[str]
) -> DataFrame:
    """Facts as rows beside dimensions of their own table; facts of one table only."""
    names = [model.named(name) for name in facts]
    homes = {model.facts[name][0] for name in names}
    dims = [model.named(name) for name in dimensions]
    if len(homes) != 1 or any(model.dimensions[name][0] not in homes for name in dims):
        raise ValueError("facts and dimensions must belong to one logical table")
    return tables[homes.pop()].select(
        *[F.expr(model.dimensions[name][1]).alias(name) for name in dims],
        *[F.expr(model.facts[name][1]).alias(name) for name in names],
    )
