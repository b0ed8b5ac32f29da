"""Data-quality gates: (check_name, expected_value, actual_value, status) rows.

Checks of one table are measured in one pass and then turned into rows. Links are checked
on distinct keys with their row counts, so a key that fills a third of a table is one row.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citedspark.fixed_values import DISCHARGE_SECTION, RESTRICTED_ANYWHERE, RESTRICTED_ON_MEMBER
from citedspark.schemas import LINKS, TABLES, Table

VALUE = "decimal(18,2)"


def gate_rows(measured: DataFrame, expected: Mapping[str, object]) -> DataFrame:
    """One row of named numbers to one gate row per name; a name without an expectation is 0.

    A NULL measurement fails.
    """
    items = [
        F.struct(
            F.lit(name).alias("check_name"),
            F.lit(str(expected.get(name, 0))).cast(VALUE).alias("expected_value"),
            F.col(f"`{name}`").cast(VALUE).alias("actual_value"),
        )
        for name in measured.columns
    ]
    status = F.when(F.col("actual_value") == F.col("expected_value"), "PASS").otherwise("FAIL")
    return measured.select(F.inline(F.array(*items))).withColumn("status", status)


def union(gates: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, gates)


# --- measurements -------------------------------------------------------------
def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row with a row count per named table."""
    sizes = union([df.select(F.lit(name).alias("name")) for name, df in tables.items()])
    return sizes.agg(*[F.count_if(F.col("name") == name).alias(name) for name in tables])


def size_differences(pairs: Mapping[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """One row: for each name, rows of the view minus rows of its table."""
    sides = [
        df.select(F.lit(name).alias("name"), F.lit(sign).alias("sign"))
        for name, (view, table) in pairs.items()
        for df, sign in ((view, 1), (table, -1))
    ]
    return union(sides).agg(
        *[F.coalesce(F.sum(F.when(F.col("name") == n, F.col("sign"))), F.lit(0)).alias(n) for n in pairs]
    )


def extra_rows(df: DataFrame, key: tuple[str, ...], name: str, blank_is_value: bool = True) -> DataFrame:
    """Rows minus distinct keys: 0 when the key is unique.

    With `blank_is_value` a NULL part counts as blank; without it a row with a NULL part has
    no key and is always extra.
    """
    parts = [F.col(part).cast("string") for part in key]
    if blank_is_value:
        parts = [F.coalesce(part, F.lit("")) for part in parts]
    keyed = df.select(F.when(reduce(lambda a, b: a & b, [p.isNotNull() for p in parts]), F.struct(*parts)).alias("k"))
    groups = keyed.groupBy("k").agg(F.count("*").alias("n"))
    return groups.agg((F.coalesce(F.sum("n"), F.lit(0)) - F.count("k")).alias(name))


def duplicate_groups(df: DataFrame, key: tuple[str, ...], name: str, tasks: int | None = None) -> DataFrame:
    """How many keys stand in several rows; keys that seldom repeat are dealt to `tasks` tasks, if given."""
    dealt = df if tasks is None else df.select(*key).repartition(tasks, *key)
    groups = dealt.groupBy(*key).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > 1)
    return groups.agg(F.count("*").alias(name))


def orphans(
    child: DataFrame, column: str, parent: DataFrame, parent_key: str, name: str, optional: bool = True
) -> DataFrame:
    """Child rows without a parent. A blank key is an orphan unless the link is optional."""
    linked = child.filter(F.col(column).isNotNull()) if optional else child
    keys = linked.groupBy(F.col(column).alias("k")).agg(F.count("*").alias("n"))
    known = parent.select(F.col(parent_key).alias("k"))
    return keys.join(known, "k", "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias(name))


def link_orphans(
    spark: SparkSession,
    links: Mapping[str, tuple[DataFrame, str, str]],
    parents: Mapping[str, tuple[DataFrame, str]],
    required: frozenset[str] = frozenset(),
) -> DataFrame:
    """One row: for each named link (child, column, parent's name) the child rows without a parent.

    All links share one grouping and one join: the keys of all children are stacked and counted,
    so a key that fills a table is one row for each of its links. A blank key is an orphan only
    of a link in `required`.
    """
    of = F.lit
    stacked = union([
        (child if name in required else child.where(F.col(column).isNotNull()))
        .select(of(name).alias("link"), of(parent).alias("parent"), F.col(column).cast("string").alias("key"))
        for name, (child, column, parent) in links.items()
    ])
    known = union([
        df.select(of(name).alias("parent"), F.col(key).cast("string").alias("key")) for name, (df, key) in parents.items()
    ])
    lost = stacked.groupBy("link", "parent", "key").agg(F.count("*").alias("n")).join(known, ["parent", "key"], "left_anti")
    return lost.agg(*[F.coalesce(F.sum(F.when(F.col("link") == name, F.col("n"))), F.lit(0)).alias(name) for name in links])


def measured(df: DataFrame, **checks: Column) -> DataFrame:
    """One row with a conditional row count per check, in one pass."""
    return df.agg(*[F.count_if(condition).alias(name) for name, condition in checks.items()])


def missing_values(df: DataFrame, table: Table) -> DataFrame:
    """NULLs per required column of a raw table."""
    required = [name for name in df.columns if not table.is_nullable(name)]
    return df.agg(*[F.count_if(F.col(name).isNull()).alias(f"missing_{table.file}_{name}") for name in required])


def column_presence(spark: SparkSession, found: Mapping[str, int]) -> DataFrame:
    """Numbers known from schemas or catalogs, as one row."""
    return spark.createDataFrame([tuple(found.values())], ", ".join(f"{name} bigint" for name in found))


def reads_table(df: DataFrame, marker: str) -> int:
    """1 when the analysed plan refers to the marker (a table, path or column), else 0."""
    return int(marker.lower() in df._jdf.queryExecution().analyzed().toString().lower())


# --- the gate families --------------------------------------------------------
def table_gates(raw: Mapping[str, DataFrame], core: Mapping[str, DataFrame], expected: Mapping[str, object]) -> DataFrame:
    """Row counts, view sizes, keys and required values of every loaded table."""
    spark_tables = {name: TABLES[name] for name in raw}
    counts = row_counts({f"raw_{name}_rows": df for name, df in raw.items()})
    views = size_differences(
        {
            f"core_{table.view}_matches_raw": (core[table.view], raw[name])
            for name, table in spark_tables.items()
            if table.view in core
        }
    )
    gates = [gate_rows(counts, expected), gate_rows(views, expected)]
    for name, table in spark_tables.items():
        gates.append(gate_rows(missing_values(raw[name], table), expected))
        if table.primary_key:
            key = "_".join(table.primary_key).lower()
            gates.append(gate_rows(extra_rows(raw[name], table.primary_key, f"unique_{name}_{key}"), expected))
        if table.business_key:
            label = f"{table.view}_business_key_extra_rows"
            gates.append(gate_rows(extra_rows(raw[name], table.business_key, label), expected))
    return union(gates)


def link_gates(raw: Mapping[str, DataFrame], expected: Mapping[str, object]) -> DataFrame:
    """Orphans of every declared link between the loaded tables."""
    gates = []
    for child, links in LINKS.items():
        for column, parent in links.items():
            if child in raw and parent in raw:
                name = f"orphan_{child}_{column.lower()}"
                key = TABLES[parent].primary_key[0]
                optional = TABLES[child].is_nullable(column)
                found = orphans(raw[child], column, raw[parent], key, name, optional)
                gates.append(gate_rows(found, expected))
    return union(gates)


def restricted_gates(
    spark: SparkSession, core: Mapping[str, DataFrame], raw_member: DataFrame | None = None
) -> DataFrame:
    """Restricted columns: none in any view, none of the wider list on the member view."""
    columns = [name.lower() for df in core.values() for name in df.columns]
    found = {
        "core_columns_named_ssn_drivers_or_passport": sum(name in RESTRICTED_ANYWHERE for name in columns),
        "core_patient_precise_or_financial_columns": sum(
            name.lower() in RESTRICTED_ON_MEMBER for name in core["patient"].columns
        ),
    }
    expected = {}
    if raw_member is not None:
        found["raw_patients_has_three_restricted_columns"] = sum(
            name.lower() in RESTRICTED_ANYWHERE for name in raw_member.columns
        )
        expected = {"raw_patients_has_three_restricted_columns": 3}
    return gate_rows(column_presence(spark, found), expected)


def cohort_gates(score: DataFrame, expected: Mapping[str, object]) -> DataFrame:
    """Every figure of the score table, read in one pass over its few rows."""
    bucket = F.col("score_bucket")

    def of(label: str, name: str) -> Column:
        return F.max(F.when(bucket == label, F.col(name)))

    figures = {
        "risk_cohort_patients": F.max("cohort_patient_count"),
        "risk_cohort_events": F.max("cohort_event_count"),
        "risk_base_rate_pct": F.max("base_rate_pct"),
        "risk_excluded_born_on_or_after_index": F.max("excluded_born_on_or_after_index"),
        "risk_excluded_dead_on_or_before_index": F.max("excluded_dead_on_or_before_index"),
        "risk_excluded_no_prior_encounter": F.max("excluded_no_prior_encounter"),
        "risk_buckets_sum_to_cohort": F.sum(F.when(bucket != "GE_2", F.col("patient_count"))),
    }
    for label in ("0", "1", "2", "3", "4", "GE_2"):
        stem = f"risk_bucket_{label.lower()}"
        figures[f"{stem}_patients"] = of(label, "patient_count")
        figures[f"{stem}_events"] = of(label, "event_count")
        if label == "4":
            figures[f"{stem}_rate_absent"] = F.count_if((bucket == label) & F.col("event_rate_pct").isNotNull())
        else:
            figures[f"{stem}_rate_pct"] = of(label, "event_rate_pct")
    return gate_rows(score.agg(*[value.alias(name) for name, value in figures.items()]), expected)


def leakage_gates(features: DataFrame, core: Mapping[str, DataFrame], spec) -> DataFrame:
    """No feature on or after the index, none from documents, none lost before the index."""
    source = F.col("source_table")
    taken = features.agg(
        F.count_if(F.col("event_ts") >= spec.index_ts).alias("risk_feature_on_or_after_index"),
        F.count_if(source == "DOCUMENT_SECTION").alias("risk_feature_document_rows"),
        *[F.count_if(source == name).alias(name) for name in ("CONDITION", "ENCOUNTER", "OBSERVATION")],
    )
    before = {
        "conditions": ("CONDITION", core["condition"], "start_date", spec.index_date),
        "encounters": ("ENCOUNTER", core["encounter"], "start_ts", spec.index_ts),
        "observations": ("OBSERVATION", core["observation"], "observation_ts", spec.index_ts),
    }
    row = taken
    for name, (_source, df, column, cut) in before.items():
        row = row.crossJoin(df.agg(F.count_if(F.col(column) < cut).alias(name)))
    return gate_rows(
        row.select(
            "risk_feature_on_or_after_index",
            "risk_feature_document_rows",
            *[
                (F.col(name) - F.col(plural)).alias(f"risk_feature_{plural}_match_pre_index")
                for plural, (name, *_rest) in before.items()
            ],
        ),
        {},
    )


def lineage_gates(spark: SparkSession, plans: Mapping[str, DataFrame], marker: str = "section_loinc") -> DataFrame:
    """The named plans do not read document cells."""
    return gate_rows(
        column_presence(
            spark, {f"{name}_has_no_document_section": reads_table(df, marker) for name, df in plans.items()}
        ),
        {},
    )


def document_gates(
    cells: DataFrame, members: DataFrame, expected: Mapping[str, object], sections: tuple[str, ...] = (),
    prefixes: tuple[str, ...] = (), tasks: int | None = None,
) -> DataFrame:
    """Documents, identity, sections, cells per prefix and forbidden sections.

    `tasks` says how many tasks the keys of all cells are dealt to, where the session's number is too few.
    """
    per_document = cells.groupBy("document_id").agg(
        F.count("*").alias("cells"),
        F.count_if(F.col("document_id") != F.col("patient_id")).alias("mismatches"),
        *[
            F.bool_or(F.col("section_loinc") == section).cast("int").alias(f"s{i}")
            for i, section in enumerate(sections)
        ],
        *[
            F.count_if(F.col("element_id").rlike(f"^{prefix}-desc-[0-9]+$")).alias(f"p{i}")
            for i, prefix in enumerate(prefixes)
        ],
        F.count_if(
            (F.col("section_loinc") == DISCHARGE_SECTION) | F.col("section_title").ilike("%discharge summary%")
        ).alias("discharge"),
    )
    measured_documents = per_document.agg(
        F.count("*").alias("document_ids"),
        F.sum("mismatches").alias("document_id_patient_id_mismatches"),
        F.sum("cells").alias("document_section_rows"),
        *[F.sum(f"s{i}").alias(f"section_{s.replace('-', '_')}_documents") for i, s in enumerate(sections)],
        *[F.sum(f"p{i}").alias(f"narrative_{p}_desc_cells") for i, p in enumerate(prefixes)],
        F.sum("discharge").alias("no_discharge_summary_sections"),
    )
    missing = members.select("patient_id").join(
        cells.select("patient_id").distinct(), "patient_id", "left_anti"
    ).agg(F.count("*").alias("patients_missing_document"))
    repeated = duplicate_groups(cells, ("document_id", "element_id"), "document_element_duplicate_groups", tasks)
    return union([gate_rows(df, expected) for df in (measured_documents, missing, repeated)])


def known_rows(df: DataFrame, expected: Mapping[str, int], **conditions: Column) -> DataFrame:
    """Counts of rows that must, or must not, be there."""
    return gate_rows(measured(df, **conditions), expected)


def catalog_gates(spark: SparkSession, published: list[str], raw: list[str]) -> DataFrame:
    """Forbidden datasets are absent; the member view and the metric model are published; no raw one is."""
    names = [name.lower() for name in published]
    found = {
        "no_openfda_objects": sum("openfda" in name for name in names),
        "no_discharge_objects": sum("discharge" in name for name in names),
        "no_dose_order_objects": sum(name in ("dose_order", "medication_order") for name in names),
        "published_raw_tables": sum(name in {r.lower() for r in raw} for name in names),
        "published_member_view": int("patient" in names),
        "published_metric_model": int("sem_member" in names),
    }
    return gate_rows(column_presence(spark, found), {"published_member_view": 1, "published_metric_model": 1})


def report(gates: DataFrame) -> DataFrame:
    """Failures first, then by name; `position` states the order. One row a gate, so a few hundred."""
    failures_first = F.when(F.col("status") == "FAIL", 0).otherwise(1)
    place = F.row_number().over(Window.partitionBy().orderBy(failures_first, "check_name"))
    return gates.withColumn("position", place).orderBy("position")


def require_all(gates: DataFrame) -> None:
    """Stop the build when any gate fails."""
    failed = gates.filter(F.col("status") != "PASS")
    count = failed.count()
    if count:
        worst = ", ".join(row["check_name"] for row in failed.orderBy("check_name").limit(10).collect())
        raise ValueError(f"{count} failed gates: {worst}")
