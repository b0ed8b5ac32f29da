"""The point-count cohort over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citedspark.plans import cohort as K
from workload.registry import query
from workload.tables import SPEC, Source


@query("SELECT * FROM v_feature")
def event_spine(spark: SparkSession, folder: str) -> DataFrame:
    return K.event_spine(Source(spark, folder).core(), SPEC)


@query(
    """SELECT patient_id, birthdate, age_years_at_index, point_age, point_prior_acute_encounter,
              active_condition_count, point_active_conditions, last_value, point_last_value, point_total,
              event_flag, DATE '1999-01-01' AS index_date, DATE '2000-01-01' AS horizon_end FROM v_cohort"""
)
def cohort_points(spark: SparkSession, folder: str) -> DataFrame:
    return K.risk_cohort(Source(spark, folder).core(), SPEC)


@query("SELECT * FROM v_score")
def score_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return K.risk_score(Source(spark, folder).core(), SPEC)


@query(
    """SELECT CAST(s.score_bucket AS INTEGER) AS score, s.patient_count,
              CAST(s.event_rate_pct / 100 AS DECIMAL(9,4)) AS event_rate,
              s.cohort_patient_count AS cohort_n, s.cohort_event_count AS event_n,
              CAST(s.base_rate_pct / 100 AS DECIMAL(9,4)) AS base_rate, g.patient_count AS ge2_patient_count,
              CAST(g.event_rate_pct / 100 AS DECIMAL(9,4)) AS ge2_event_rate,
              CASE WHEN s.cohort_patient_count > 0 THEN DATE '1999-01-01' END AS index_date,
              CASE WHEN s.cohort_patient_count > 0 THEN DATE '2000-01-01' END AS horizon_end,
              s.excluded_dead_on_or_before_index AS excluded_dead,
              s.excluded_born_on_or_after_index AS excluded_born
       FROM v_score s CROSS JOIN (SELECT patient_count, event_rate_pct FROM v_score
                                  WHERE score_bucket = 'GE_2') g
       WHERE s.score_bucket <> 'GE_2'"""
)
def score_contract(spark: SparkSession, folder: str) -> DataFrame:
    return K.risk_contract(Source(spark, folder).core(), SPEC)


@query(
    """SELECT excluded_born_on_or_after_index, excluded_dead_on_or_before_index, excluded_no_prior_encounter
       FROM v_score WHERE sort_order = 0"""
)
def cohort_exclusions(spark: SparkSession, folder: str) -> DataFrame:
    return K.risk_score(Source(spark, folder).core(), SPEC).filter("sort_order = 0").select(
        "excluded_born_on_or_after_index",
        "excluded_dead_on_or_before_index",
        "excluded_no_prior_encounter",
    )


@query(
    """SELECT patient_id, value_text, TRY_CAST(value_text AS DECIMAL(18,4)) AS last_value
       FROM v_feature WHERE source_table = 'OBSERVATION' AND code = 'total'
       QUALIFY ROW_NUMBER() OVER (PARTITION BY patient_id
                                  ORDER BY event_ts DESC, source_file_row_number DESC) = 1"""
)
def last_value_per_member(spark: SparkSession, folder: str) -> DataFrame:
    features = K.event_spine(Source(spark, folder).core(), SPEC)
    return K.last_value_per_member(features, SPEC.value_code).select("patient_id", "value_text", "last_value")
