"""Quality gates and the metric layer over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citedspark.operators import gates as G
from citedspark.operators import metrics as S
from citedspark.plans import cohort as K
from workload.registry import query
from workload.tables import SPEC, Source


def gate_sql(checks: dict[str, tuple[object, str]]) -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{name}' AS check_name, CAST({expected} AS DECIMAL(18,2)) AS expected_value, "
        f"CAST(({actual}) AS DECIMAL(18,2)) AS actual_value"
        for name, (expected, actual) in checks.items()
    )
    return (
        "SELECT check_name, expected_value, actual_value, "
        f"CASE WHEN actual_value = expected_value THEN 'PASS' ELSE 'FAIL' END AS status FROM ({rows})"
    )


TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
    "benchmark", "labels", "conversations",
)


@query(gate_sql({f"raw_{t}_rows": (0, f"SELECT COUNT(*) FROM {t}") for t in TABLES}))
def row_count_gates(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes of the given tables; nothing is expected of them, so filled tables fail."""
    source = Source(spark, folder)
    return G.gate_rows(G.row_counts({f"raw_{t}_rows": source.table(t) for t in TABLES}), {})


# A view and the tables whose rows it should have; claims are fewer than lines, cells are more.
PAIRS = {
    "patient": ("customer",), "encounter": ("orders",), "condition": ("lineitem",), "medication": ("lineitem",),
    "procedure": ("lineitem",), "payer": ("nation",), "payer_transition": ("orders",), "claim_line": ("lineitem",),
    "observation": ("events", "orders"), "allergy": ("orders",), "careplan": ("orders",), "immunization": ("events",),
    "device": ("lineitem",), "imaging_study": ("orders",), "supply": ("lineitem",), "claim": ("lineitem",),
    "document_section": ("lineitem",),
}
SQL_NAME = {"payer_transition": "v_transition", "imaging_study": "v_imaging", "document_section": "v_section"}


def _view(name: str) -> str:
    return SQL_NAME.get(name, f"v_{name}")


VIEW_CHECKS = {
    f"core_{view}_matches_raw": (
        0, f"(SELECT COUNT(*) FROM {_view(view)}) - " + " - ".join(f"(SELECT COUNT(*) FROM {table})" for table in tables)
    )
    for view, tables in PAIRS.items()
}


@query(gate_sql(VIEW_CHECKS))
def view_count_gates(spark: SparkSession, folder: str) -> DataFrame:
    source = Source(spark, folder)
    core = source.core()

    def rows(tables: tuple[str, ...]) -> DataFrame:
        return G.union([source.table(table).select(F.lit(1).alias("one")) for table in tables])

    pairs = {f"core_{view}_matches_raw": (core[view], rows(tables)) for view, tables in PAIRS.items()}
    return G.gate_rows(G.size_differences(pairs), {})


KEYS = {"customer": ("c_custkey",), "orders": ("o_orderkey",), "lineitem": ("l_orderkey", "l_linenumber"),
        "events": ("event_id",), "part": ("p_partkey",), "supplier": ("s_suppkey",)}


@query(
    gate_sql(
        {
            f"unique_{table}": (0, f"SELECT COUNT(*) - COUNT(DISTINCT ({', '.join(key)})) FROM {table}")
            for table, key in KEYS.items()
        }
    )
)
def key_gates(spark: SparkSession, folder: str) -> DataFrame:
    source = Source(spark, folder)
    return G.union(
        [G.gate_rows(G.extra_rows(source.table(t), key, f"unique_{t}"), {}) for t, key in KEYS.items()]
    )


@query(
    gate_sql(
        {
            "medication_extra_rows": (
                0,
                """SELECT COUNT(*) - COUNT(DISTINCT patient_id || '|' || encounter_id || '|' || code || '|' || start_ts)
                   FROM v_medication""",
            ),
            "observation_extra_rows": (
                0,
                """SELECT COUNT(*) - COUNT(DISTINCT patient_id || '|' || COALESCE(encounter_id, '') || '|' || code
                       || '|' || value_text) FROM v_observation""",
            ),
            "immunization_extra_rows": (
                0,
                "SELECT COUNT(*) - COUNT(DISTINCT patient_id || '|' || encounter_id || '|' || code) FROM v_immunization",
            ),
            "medication_duplicate_groups": (
                0,
                """SELECT COUNT(*) FROM (SELECT 1 FROM v_medication GROUP BY patient_id, encounter_id, code
                                         HAVING COUNT(*) > 1)""",
            ),
        }
    )
)
def business_key_gates(spark: SparkSession, folder: str) -> DataFrame:
    """Keys that need not be unique; a NULL part either counts as blank or leaves the row without a key."""
    core = Source(spark, folder).core()
    key = ("patient_id", "encounter_id", "code")
    return G.union(
        [
            G.gate_rows(df, {})
            for df in (
                G.extra_rows(core["medication"], (*key, "start_ts"), "medication_extra_rows"),
                G.extra_rows(core["observation"], (*key, "value_text"), "observation_extra_rows"),
                G.extra_rows(core["immunization"], key, "immunization_extra_rows", blank_is_value=False),
                G.duplicate_groups(core["medication"], key, "medication_duplicate_groups"),
            )
        ]
    )


LINKS = (
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("events", "user_id", "customer", "c_custkey"),
    # Not a link: order keys reach beyond the members, so this one has orphans.
    ("orders", "o_orderkey", "customer", "c_custkey"),
)


@query(
    gate_sql(
        {
            f"orphan_{child}_{column}": (
                0,
                f"SELECT COUNT(*) FROM {child} c LEFT JOIN {parent} p ON c.{column} = p.{key} "
                f"WHERE c.{column} IS NOT NULL AND p.{key} IS NULL",
            )
            for child, column, parent, key in LINKS
        }
    )
)
def orphan_gates(spark: SparkSession, folder: str) -> DataFrame:
    source = Source(spark, folder)
    return G.union(
        [
            G.gate_rows(G.orphans(source.table(c), column, source.table(p), key, f"orphan_{c}_{column}"), {})
            for c, column, p, key in LINKS
        ]
    )


PARENTS = {"patient": "patient_id", "encounter": "encounter_id", "payer": "payer_id", "claim": "claim_id"}
VIEW_LINKS = {
    **{f"{view}_{key}": (view, key, parent)
       for view in ("condition", "medication", "procedure", "allergy", "careplan", "immunization", "imaging_study", "device",
                    "supply", "observation")
       for key, parent in (("patient_id", "patient"), ("encounter_id", "encounter"))},
    **{f"{view}_{key}": (view, key, parent) for view, key, parent in (
        ("encounter", "patient_id", "patient"), ("claim", "patient_id", "patient"), ("claim", "appointment_id", "encounter"),
        ("claim", "primary_payer_id", "payer"), ("claim_line", "claim_id", "claim"), ("claim_line", "patient_id", "patient"),
        ("claim_line", "appointment_id", "encounter"), ("payer_transition", "patient_id", "patient"),
        ("payer_transition", "payer_id", "payer"), ("payer_transition", "secondary_payer_id", "payer"),
        ("document_section", "patient_id", "patient"),
    )},
}
LINK_CHECKS = {
    f"link_{name}": (
        0,
        f"SELECT COUNT(*) FROM {_view(view)} c WHERE c.{key} IS NOT NULL AND c.{key} NOT IN "
        f"(SELECT {PARENTS[parent]} FROM {_view(parent)})",
    )
    for name, (view, key, parent) in VIEW_LINKS.items()
}


def _link_gates(spark: SparkSession, core) -> DataFrame:
    links = {f"link_{name}": (core[view], key, parent) for name, (view, key, parent) in VIEW_LINKS.items()}
    return G.gate_rows(G.link_orphans(spark, links, {name: (core[name], key) for name, key in PARENTS.items()}), {})


@query(gate_sql(LINK_CHECKS))
def link_gates(spark: SparkSession, folder: str) -> DataFrame:
    """Every link between the views: rows whose key has no parent."""
    return _link_gates(spark, Source(spark, folder).core())


KNOWN = {
    "failed_high_orders": (0, "SELECT COUNT(*) FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 400000"),
    "first_order": (1, "SELECT COUNT(*) FROM orders WHERE o_orderkey = (SELECT MIN(o_orderkey) FROM orders)"),
    "unknown_status": (0, "SELECT COUNT(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O', 'P')"),
    "urgent_orders": (1, "SELECT COUNT(*) FROM orders WHERE o_orderpriority ILIKE '%urgent%'"),
}


@query(gate_sql(KNOWN))
def known_row_gates(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that must, or must not, be there; two of the expectations are wrong."""
    orders = Source(spark, folder).table("orders")
    first = orders.agg(F.min("o_orderkey")).first()[0]
    status = F.col("o_orderstatus")
    return G.known_rows(
        orders, {name: expected for name, (expected, _) in KNOWN.items()},
        failed_high_orders=(status == "F") & (F.col("o_totalprice") > 400000),
        first_order=F.col("o_orderkey") == F.lit(first),
        unknown_status=~status.isin("F", "O", "P"),
        urgent_orders=F.col("o_orderpriority").ilike("%urgent%"),
    )


@query(
    f"""SELECT *, CAST(ROW_NUMBER() OVER (ORDER BY CASE status WHEN 'FAIL' THEN 0 ELSE 1 END, check_name) AS INTEGER)
               AS position FROM ({gate_sql({**VIEW_CHECKS, **KNOWN, **LINK_CHECKS})})"""
)
def gate_report(spark: SparkSession, folder: str) -> DataFrame:
    """Three families of gates in one report, failures first."""
    families = [view_count_gates(spark, folder), known_row_gates(spark, folder), link_gates(spark, folder)]
    return G.report(G.union(families))


@query(
    gate_sql(
        {
            "blank_encounter_and_category": (
                0, "SELECT COUNT(*) FROM v_observation WHERE encounter_id IS NULL AND category IS NULL"
            ),
            "blank_encounter_only": (
                0, "SELECT COUNT(*) FROM v_observation WHERE encounter_id IS NULL AND category IS NOT NULL"
            ),
            "blank_category_only": (
                0, "SELECT COUNT(*) FROM v_observation WHERE encounter_id IS NOT NULL AND category IS NULL"
            ),
            "coded_rows": (0, "SELECT COUNT(*) FROM v_observation WHERE code = 'total'"),
            "coverage_spans_without_member_id": (0, "SELECT COUNT(*) FROM v_transition WHERE member_id IS NULL"),
            "deaths": (0, "SELECT COUNT(*) FROM v_patient WHERE deathdate IS NOT NULL"),
        }
    )
)
def blank_and_domain_gates(spark: SparkSession, folder: str) -> DataFrame:
    core = Source(spark, folder).core()
    no_encounter, no_category = F.col("encounter_id").isNull(), F.col("category").isNull()
    observed = G.measured(
        core["observation"],
        blank_encounter_and_category=no_encounter & no_category,
        blank_encounter_only=no_encounter & ~no_category,
        blank_category_only=~no_encounter & no_category,
        coded_rows=F.col("code") == "total",
    )
    spans = G.measured(core["payer_transition"], coverage_spans_without_member_id=F.col("member_id").isNull())
    deaths = G.measured(core["patient"], deaths=F.col("deathdate").isNotNull())
    return G.union([G.gate_rows(df, {}) for df in (observed, spans, deaths)])


def _score(column: str, bucket: str) -> str:
    return f"SELECT {column} FROM v_score WHERE score_bucket = '{bucket}'"


@query(
    gate_sql(
        {
            "risk_cohort_patients": (0, "SELECT MAX(cohort_patient_count) FROM v_score"),
            "risk_cohort_events": (0, "SELECT MAX(cohort_event_count) FROM v_score"),
            "risk_base_rate_pct": (0, "SELECT MAX(base_rate_pct) FROM v_score"),
            "risk_excluded_born_on_or_after_index": (
                0, "SELECT MAX(excluded_born_on_or_after_index) FROM v_score"
            ),
            "risk_excluded_dead_on_or_before_index": (
                0, "SELECT MAX(excluded_dead_on_or_before_index) FROM v_score"
            ),
            "risk_excluded_no_prior_encounter": (0, "SELECT MAX(excluded_no_prior_encounter) FROM v_score"),
            "risk_buckets_sum_to_cohort": (
                0, "SELECT SUM(patient_count) FROM v_score WHERE score_bucket <> 'GE_2'"
            ),
            **{
                f"risk_bucket_{b.lower()}_{name}": (0, _score(column, b))
                for b in ("0", "1", "2", "3", "4", "GE_2")
                for name, column in (("patients", "patient_count"), ("events", "event_count"))
            },
            **{
                f"risk_bucket_{b.lower()}_rate_pct": (0, _score("event_rate_pct", b))
                for b in ("0", "1", "2", "3", "GE_2")
            },
            "risk_bucket_4_rate_absent": (
                0, "SELECT CASE WHEN event_rate_pct IS NULL THEN 0 ELSE 1 END FROM v_score WHERE score_bucket = '4'"
            ),
        }
    )
)
def cohort_gates(spark: SparkSession, folder: str) -> DataFrame:
    return G.cohort_gates(K.risk_score(Source(spark, folder).core(), SPEC), {})


@query(
    gate_sql(
        {
            "risk_feature_on_or_after_index": (
                0, "SELECT COUNT(*) FROM v_feature WHERE event_ts >= TIMESTAMP '1999-01-01'"
            ),
            "risk_feature_document_rows": (
                0, "SELECT COUNT(*) FROM v_feature WHERE source_table = 'DOCUMENT_SECTION'"
            ),
            **{
                f"risk_feature_{view}s_match_pre_index": (
                    0,
                    f"(SELECT COUNT(*) FROM v_feature WHERE source_table = '{view.upper()}') - "
                    f"(SELECT COUNT(*) FROM v_{view} WHERE {column} < DATE '1999-01-01')",
                )
                for view, column in (
                    ("condition", "start_date"), ("encounter", "start_ts"), ("observation", "observation_ts"),
                )
            },
        }
    )
)
def leakage_gates(spark: SparkSession, folder: str) -> DataFrame:
    core = Source(spark, folder).core()
    return G.leakage_gates(K.event_spine(core, SPEC), core, SPEC)


SECTIONS = ("11450-4", "10160-0", "47519-4", "48765-2", "18776-5", "11369-6")
PREFIXES = ("medications", "conditions", "procedures", "allergies", "careplans")


@query(
    gate_sql(
        {
            "document_ids": (0, "SELECT COUNT(DISTINCT document_id) FROM v_section"),
            "document_id_patient_id_mismatches": (
                0, "SELECT COUNT(*) FROM v_section WHERE document_id <> patient_id"
            ),
            "document_section_rows": (0, "SELECT COUNT(*) FROM v_section"),
            **{
                f"section_{s.replace('-', '_')}_documents": (
                    0, f"SELECT COUNT(DISTINCT document_id) FROM v_section WHERE section_loinc = '{s}'"
                )
                for s in SECTIONS
            },
            **{
                f"narrative_{p}_desc_cells": (
                    0, f"SELECT COUNT(*) FROM v_section WHERE regexp_matches(element_id, '^{p}-desc-[0-9]+$')"
                )
                for p in PREFIXES
            },
            "no_discharge_summary_sections": (
                0,
                """SELECT COUNT(*) FROM v_section WHERE section_loinc = '18842-5'
                   OR section_title ILIKE '%discharge summary%'""",
            ),
            "patients_missing_document": (
                0,
                """SELECT COUNT(*) FROM v_patient p LEFT JOIN (SELECT DISTINCT patient_id FROM v_section) d
                   ON d.patient_id = p.patient_id WHERE d.patient_id IS NULL""",
            ),
            "document_element_duplicate_groups": (
                0,
                """SELECT COUNT(*) FROM (SELECT 1 FROM v_section GROUP BY document_id, element_id
                                         HAVING COUNT(*) > 1)""",
            ),
        }
    )
)
def document_gates(spark: SparkSession, folder: str) -> DataFrame:
    core = Source(spark, folder).core()
    return G.document_gates(core["document_section"], core["patient"], {}, SECTIONS, PREFIXES, core.tasks)


@query(
    """SELECT p.city, p.gender, e.encounter_class, COUNT(*) AS encounter_count
       FROM v_encounter e LEFT JOIN v_patient p ON p.patient_id = e.patient_id GROUP BY 1, 2, 3"""
)
def metric_query(spark: SparkSession, folder: str) -> DataFrame:
    """One metric by dimensions of its own table and of the linked one."""
    core = Source(spark, folder).core()
    tables = S.model_tables(core, K.risk_cohort(core, SPEC))
    return S.metric_query(S.MEMBER_MODEL, tables, ["encounter_count"], ["city", "gender", "encounter_class"])


@query(
    """SELECT state, CAST(SUM(m) AS BIGINT) AS member_count, CAST(SUM(e) AS BIGINT) AS encounter_count,
              CAST(SUM(c) AS BIGINT) AS claim_count, CAST(SUM(d) AS BIGINT) AS medication_row_count,
              CAST(SUM(k) AS BIGINT) AS cohort_patient_count, CAST(SUM(a) AS BIGINT) AS acute_event_count
       FROM (
           SELECT state, 1 AS m, 0 AS e, 0 AS c, 0 AS d, 0 AS k, 0 AS a FROM v_patient
           UNION ALL SELECT p.state, 0, 1, 0, 0, 0, 0 FROM v_encounter x LEFT JOIN v_patient p USING (patient_id)
           UNION ALL SELECT p.state, 0, 0, 1, 0, 0, 0 FROM v_claim x LEFT JOIN v_patient p USING (patient_id)
           UNION ALL SELECT p.state, 0, 0, 0, 1, 0, 0 FROM v_medication x LEFT JOIN v_patient p USING (patient_id)
           UNION ALL SELECT p.state, 0, 0, 0, 0, 1, event_flag FROM v_cohort x LEFT JOIN v_patient p USING (patient_id)
       ) GROUP BY state"""
)
def metrics_of_several_tables(spark: SparkSession, folder: str) -> DataFrame:
    """All six metrics by the member's state: each on its own table, met on the dimension."""
    core = Source(spark, folder).core()
    tables = S.model_tables(core, K.risk_cohort(core, SPEC))
    return S.metric_query(S.MEMBER_MODEL, tables, list(S.MEMBER_MODEL.metrics), ["state"])


@query(
    """SELECT p.patient_id, COUNT(*) AS medication_row_count
       FROM v_medication m LEFT JOIN v_patient p ON p.patient_id = m.patient_id
       WHERE m.code LIKE '1000%' GROUP BY 1"""
)
def metric_by_synonym(spark: SparkSession, folder: str) -> DataFrame:
    """A dimension asked for by synonyms, with a condition on another dimension."""
    core = Source(spark, folder).core()
    tables = S.model_tables(core, K.risk_cohort(core, SPEC))
    by_code = S.metric_query(
        S.MEMBER_MODEL, tables, ["medication_row_count"], ["beneficiary id", "rxnorm"],
        F.col("medication_code").startswith("1000"),
    )
    return by_code.groupBy("patient_id").agg(F.sum("medication_row_count").alias("medication_row_count"))


@query("SELECT encounter_id, encounter_class, total_claim_cost FROM v_encounter")
def fact_rows(spark: SparkSession, folder: str) -> DataFrame:
    core = Source(spark, folder).core()
    return S.fact_rows(
        S.MEMBER_MODEL, {"encounter": core["encounter"]}, ["total_claim_cost"], ["encounter_id", "encounter_class"]
    )
