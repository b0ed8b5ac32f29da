"""Members: directory, summary, panels, top rows, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citedspark.functions import columns as C
from citedspark.plans import member as M
from citedspark.session import scratch_path
from workload.registry import query
from workload.tables import Source


def counted(name: str, view: str, extra: str = "") -> str:
    return f"LEFT JOIN (SELECT patient_id, COUNT(*) AS n{extra} FROM {view} GROUP BY patient_id) {name} " \
           f"ON {name}.patient_id = p.patient_id"


@query(
    f"""
    SELECT p.patient_id, p.first_name, p.last_name, p.birthdate, p.deathdate, p.gender, p.city, p.state,
           COALESCE(e.n, 0) AS encounter_count, e.latest AS last_encounter_ts, COALESCE(c.n, 0) AS claim_count,
           COALESCE(m.n, 0) AS medication_count, COALESCE(k.n, 0) AS condition_count,
           COALESCE(o.n, 0) AS observation_count, COALESCE(a.n, 0) AS allergy_count,
           COALESCE(s.n, 0) AS coverage_span_count, COALESCE(s.filled, 0) AS coverage_span_with_member_id_count,
           COALESCE(d.n, 0) AS document_count
    FROM v_patient p
    {counted('e', 'v_encounter', ', MAX(start_ts) AS latest')}
    {counted('c', 'v_claim')} {counted('m', 'v_medication')} {counted('k', 'v_condition')}
    {counted('o', 'v_observation')} {counted('a', 'v_allergy')}
    {counted('s', 'v_transition', ', COUNT(member_id) AS filled')}
    LEFT JOIN (SELECT patient_id, COUNT(DISTINCT document_id) AS n FROM v_section GROUP BY patient_id) d
           ON d.patient_id = p.patient_id
    """
)
def member_summary(spark: SparkSession, folder: str) -> DataFrame:
    return M.member_summary(Source(spark, folder).core())


@query(
    """SELECT patient_id, member_id, start_ts, end_ts, payer_id, payer_name, secondary_payer_id,
              plan_ownership, owner_name FROM v_coverage"""
)
def member_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return M.member_coverage(Source(spark, folder).core())


@query(
    """SELECT patient_id, encounter_id, encounter_class, start_ts AS encounter_start_ts, claim_id,
              appointment_id, diagnosis_1, primary_payer_id FROM v_claim_encounter"""
)
def member_encounter_claim(spark: SparkSession, folder: str) -> DataFrame:
    return M.member_encounter_claim(Source(spark, folder).core())


@query(
    """SELECT patient_id, first_name, last_name, birthdate, deathdate, gender, city, state,
              ROW_NUMBER() OVER (ORDER BY last_name, first_name, patient_id) AS place
       FROM v_patient ORDER BY place"""
)
def member_directory(spark: SparkSession, folder: str) -> DataFrame:
    """The directory with each member's place in its order, so the order itself is compared."""
    from citedspark.operators.ranking import running_total

    directory = M.member_directory(Source(spark, folder).core())
    order = ["last_name", "first_name", "patient_id"]
    return running_total(directory, [], order, F.lit(1), "before").select(
        "patient_id", *M.PROFILE, (F.col("before") + 1).alias("place")
    )


@query("SELECT patient_id, encounter_class, COUNT(*) AS encounter_count FROM v_encounter GROUP BY 1, 2")
def encounter_class_counts(spark: SparkSession, folder: str) -> DataFrame:
    return M.encounter_class_counts(Source(spark, folder).core())


@query(
    """
    SELECT patient_id, CAST(SUM(lab) AS BIGINT) AS lab_count, CAST(SUM(claim) AS BIGINT) AS claim_count,
           CAST(SUM(line) AS BIGINT) AS line_count
    FROM (SELECT patient_id, 1 AS lab, 0 AS claim, 0 AS line FROM v_observation WHERE lower(category) = 'laboratory'
          UNION ALL SELECT patient_id, 0, 1, 0 FROM v_claim
          UNION ALL SELECT patient_id, 0, 0, 1 FROM v_claim_line) GROUP BY patient_id
    """
)
def child_counts(spark: SparkSession, folder: str) -> DataFrame:
    return M.child_counts(Source(spark, folder).core())


def ranked(columns: str, view: str, order: str, limit: int, where: str = "TRUE") -> str:
    return f"""SELECT patient_id, {columns}, CAST(ROW_NUMBER() OVER w AS INTEGER) AS position
               FROM {view} WHERE {where}
               WINDOW w AS (PARTITION BY patient_id ORDER BY {order})
               QUALIFY ROW_NUMBER() OVER w <= {limit}"""


def panel_query(name: str, sql: str) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return M.panel(Source(spark, folder).core(), name)

    run.__name__ = f"panel_{name}"
    query(sql)(run)


LAB = "lower(category) = 'laboratory'"
panel_query(
    "encounters",
    ranked(
        "encounter_id, start_ts, stop_ts, encounter_class, code, description", "v_encounter",
        "start_ts DESC, encounter_id", 15,
    ),
)
panel_query(
    "conditions",
    ranked(
        "start_date AS start_ts, stop_date AS stop_ts, encounter_id, code, description", "v_condition",
        "start_date, code, encounter_id, row_no", 1 << 40,
    ),
)
panel_query(
    "medications",
    ranked(
        "start_ts, stop_ts, encounter_id, code, description, dispenses", "v_medication",
        "start_ts, code, encounter_id, row_no", 1 << 40,
    ),
)
panel_query(
    "labs",
    ranked(
        """observation_ts AS observed_at, encounter_id, code, description, value_text AS "value", units""",
        "v_observation", "observation_ts DESC, row_no DESC", 25, LAB,
    ),
)
panel_query(
    "coverage",
    ranked(
        "start_ts AS start_date, end_ts AS end_date, member_id, payer_id, payer_name", "v_coverage",
        "start_ts, payer_id, end_ts, member_id", 1 << 40,
    ),
)
panel_query(
    "recent_encounters",
    ranked(
        'encounter_id, start_ts AS "start", stop_ts, encounter_class, code, description', "v_encounter",
        "start_ts DESC, encounter_id", 5,
    ),
)
EVIDENCE_ORDER = "code, encounter_id, row_no"
panel_query(
    "condition_evidence",
    ranked(
        'encounter_id, start_date AS "start", stop_date, code, description', "v_condition",
        f"CASE WHEN stop_date IS NULL THEN 0 ELSE 1 END, start_date DESC, {EVIDENCE_ORDER}", 10,
    ),
)
panel_query(
    "medication_evidence",
    ranked(
        'encounter_id, start_ts AS "start", stop_ts, code, description, dispenses', "v_medication",
        f"start_ts DESC, {EVIDENCE_ORDER}", 10,
    ),
)
panel_query(
    "care_plan_evidence",
    ranked(
        """encounter_id, start_date AS "start", stop_date, careplan_id, code, description, reason_code,
           reason_description""",
        "v_careplan", "start_date DESC, code, careplan_id", 10,
    ),
)
panel_query(
    "lab_evidence",
    ranked(
        """encounter_id, row_no AS row_id, observation_ts AS observed_at, code, description,
           value_text AS "value", units""",
        "v_observation", "observation_ts DESC, row_no DESC", 10, LAB,
    ),
)
panel_query(
    "procedure_evidence",
    ranked(
        """encounter_id, start_ts AS "start", stop_ts, code, description, reason_code, reason_description""",
        "v_procedure", f"start_ts DESC, {EVIDENCE_ORDER}", 10,
    ),
)
panel_query(
    "immunization_evidence",
    ranked(
        'encounter_id, immunization_ts AS "start", code, description', "v_immunization",
        f"immunization_ts DESC, {EVIDENCE_ORDER}", 10,
    ),
)
panel_query(
    "coverage_evidence",
    ranked(
        'start_ts AS "start", end_ts AS "end", member_id, payer_id, payer_name', "v_coverage",
        "start_ts DESC, payer_id, end_ts, member_id NULLS LAST", 10,
    ),
)


@query(
    ranked(
        """claim_id, encounter_id, service_ts AS service_date, diagnosis_1 AS diagnosis1, encounter_class,
           description AS encounter_description""",
        "v_claim_encounter", "service_ts DESC, claim_id", 5,
    )
)
def claim_evidence(spark: SparkSession, folder: str) -> DataFrame:
    return M.claim_evidence(Source(spark, folder).core())


@query(
    """SELECT patient_id, claim_id, appointment_id, encounter_id, diagnosis_1 AS diagnosis1,
              service_ts AS service_date
       FROM v_claim_encounter
       QUALIFY ROW_NUMBER() OVER (PARTITION BY patient_id ORDER BY service_ts, claim_id) = 1"""
)
def first_claim_on_encounter(spark: SparkSession, folder: str) -> DataFrame:
    return M.first_claim_on_encounter(Source(spark, folder).core())


@query(
    """SELECT patient_id, encounter_id, start_ts AS "start", code, description FROM v_medication
       WHERE upper(description) LIKE '%FEXOFENADINE%' OR upper(description) LIKE '%ANTIHISTAMINE%'"""
)
def antihistamine_rows(spark: SparkSession, folder: str) -> DataFrame:
    return M.antihistamine_rows(Source(spark, folder).core())


@query(
    """SELECT patient_id, encounter_id, start_date AS "start", code, description,
              CAST(NULL AS VARCHAR) AS reaction1, CAST(NULL AS VARCHAR) AS description1,
              CAST(NULL AS VARCHAR) AS severity1
       FROM v_allergy WHERE strftime(start_date, '%Y-%m-%d') LIKE '1998-0%'"""
)
def allergy_rows_by_day(spark: SparkSession, folder: str) -> DataFrame:
    """A day prefix, here the first nine months of 1998."""
    return M.allergy_rows(Source(spark, folder).core(), day="1998-0")


@query(
    """SELECT document_id, patient_id, section_loinc, section_title, element_id, "text", code,
              CAST(ROW_NUMBER() OVER (PARTITION BY patient_id ORDER BY element_id, document_id, "text") AS INTEGER) AS position
       FROM v_section WHERE section_loinc = '48765-2'"""
)
def section_cells(spark: SparkSession, folder: str) -> DataFrame:
    return M.section_cells(Source(spark, folder).core(), "48765-2")


@query(
    """SELECT s.patient_id, s.element_id, m.code AS medication_code, s.code, s."text"
       FROM v_section s
       JOIN (SELECT DISTINCT patient_id, code, description FROM v_medication
             WHERE upper(description) LIKE '%FEXOFENADINE%') m ON m.patient_id = s.patient_id
       WHERE s.section_loinc = '10160-0'
         AND (s.code = m.code OR contains(s.code, m.code) OR contains(upper(s."text"), upper(m.description)))"""
)
def medication_section_match(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of the medication section about each antihistamine row of the same member."""
    core = Source(spark, folder).core()
    rows = M.antihistamine_rows(core).select(
        "patient_id", F.col("code").alias("medication_code"), "description"
    ).distinct()
    cells = core["document_section"].filter(F.col("section_loinc") == "10160-0")
    return cells.join(rows, "patient_id").filter(
        M.about_medication(F.col("code"), F.col("text"), F.col("medication_code"), F.col("description"))
    ).select("patient_id", "element_id", "medication_code", "code", "text")


@query(
    """SELECT patient_id, section_loinc, COUNT(*) AS rows_with_evidence FROM v_section
       WHERE section_loinc IN ('11450-4', '10160-0', '18776-5', '47519-4', '11369-6') GROUP BY 1, 2"""
)
def section_counts(spark: SparkSession, folder: str) -> DataFrame:
    sections = ("11450-4", "10160-0", "18776-5", "47519-4", "11369-6")
    return M.section_counts(Source(spark, folder).core(), sections)


@query("SELECT section_loinc, COUNT(DISTINCT document_id) AS documents FROM v_section GROUP BY 1")
def section_documents(spark: SparkSession, folder: str) -> DataFrame:
    return M.section_documents(Source(spark, folder).core())


@query(
    """SELECT (SELECT COUNT(*) FROM v_patient) AS member_count,
              (SELECT COUNT(*) FROM v_encounter) AS encounter_count,
              (SELECT COUNT(*) FROM v_claim_encounter) AS claims_on_encounter,
              (SELECT COUNT(DISTINCT d.document_id) FROM v_section d JOIN v_patient p
                 ON d.document_id = p.patient_id) AS documents_matched"""
)
def population_row(spark: SparkSession, folder: str) -> DataFrame:
    return M.population(Source(spark, folder).core())


@query(
    """SELECT first_name, last_name, COUNT(*) AS matches,
              CASE WHEN COUNT(*) = 1 THEN MIN(patient_id) END AS patient_id
       FROM v_patient GROUP BY 1, 2"""
)
def name_resolution(spark: SparkSession, folder: str) -> DataFrame:
    from citedspark.plans.questions import names_to_members

    return names_to_members(Source(spark, folder).core())


@query(
    """SELECT o_orderkey, CAST(date_sub('year', CAST(o_orderdate AS DATE), DATE '2003-02-28') AS INTEGER) AS years
       FROM orders"""
)
def completed_years(spark: SparkSession, folder: str) -> DataFrame:
    orders = Source(spark, folder).table("orders")
    at = F.to_date(F.lit("2003-02-28"))
    return orders.select("o_orderkey", C.completed_years(F.to_date("o_orderdate"), at).alias("years"))


@query(
    """SELECT row_no, TRY_CAST(value_text AS DECIMAL(38,0)) AS value_numeric,
              TRY_CAST(value_text AS DECIMAL(18,4)) AS value_scaled FROM v_observation"""
)
def numeric_from_text(spark: SparkSession, folder: str) -> DataFrame:
    observed = Source(spark, folder).observation()
    return observed.select(
        F.col("source_file_row_number").alias("row_no"),
        C.whole_number(F.col("value_text")).alias("value_numeric"),
        C.scaled_number(F.col("value_text")).alias("value_scaled"),
    )


@query(
    """SELECT event_id,
              CASE WHEN lower(trim(v)) NOT IN ('', 'none', 'nan', 'null') THEN trim(v) END AS patient_id,
              strftime(ts, '%Y-%m-%d %H:%M:%S') AS "start"
       FROM (SELECT event_id, ts, CASE event_type WHEN 'error' THEN ' None ' WHEN 'click' THEN '  '
                    WHEN 'view' THEN ' NaN' ELSE ' ' || user_id || ' ' END AS v FROM events)"""
)
def row_normalise(spark: SparkSession, folder: str) -> DataFrame:
    """Mixed-case names, padded and blank-word values, and an alias to fill."""
    events = Source(spark, folder).table("events")
    value = (
        F.when(F.col("event_type") == "error", " None ")
        .when(F.col("event_type") == "click", "  ")
        .when(F.col("event_type") == "view", " NaN")
        .otherwise(F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit(" ")))
    )
    messy = events.select(
        F.col("event_id").alias("EVENT_ID"), value.alias("PATIENT"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Observed_At"),
    )
    return C.normalised_rows(messy).select(F.col("event_id").cast("bigint"), "patient_id", "start")


def _chart(panel: str, view: str, at: str, code: str, label: str, order: str, limit: int = 1 << 40, where: str = "TRUE") -> str:
    return f"""SELECT patient_id, '{panel}' AS panel, CAST(ROW_NUMBER() OVER w AS INTEGER) AS position,
                      CAST({at} AS VARCHAR) AS moment, {code} AS code, CAST({label} AS VARCHAR) AS label
               FROM {view} WHERE {where} WINDOW w AS (PARTITION BY patient_id ORDER BY {order})
               QUALIFY ROW_NUMBER() OVER w <= {limit}"""


def _chart_count(panel: str, view: str, where: str = "TRUE") -> str:
    return f"""SELECT patient_id, '{panel}', 1, NULL, NULL, CAST(COUNT(*) AS VARCHAR) FROM {view} WHERE {where}
               GROUP BY patient_id"""


CHART_VIEWS = {
    "v_class_count": "SELECT patient_id, encounter_class, COUNT(*) AS n FROM v_encounter GROUP BY 1, 2",
    "v_chart": " UNION ALL ".join([
        _chart("encounter_counts", "v_class_count", "NULL", "encounter_class", "n", "n DESC, encounter_class"),
        _chart("encounters", "v_encounter", "start_ts", "encounter_id", "description", "start_ts DESC, encounter_id", 15),
        _chart("conditions", "v_condition", "start_date", "code", "description", "start_date, code, encounter_id, row_no"),
        _chart("medications", "v_medication", "start_ts", "code", "description", "start_ts, code, encounter_id, row_no"),
        _chart("labs", "v_observation", "observation_ts", "code", "value_text", "observation_ts DESC, row_no DESC", 25, LAB),
        _chart_count("lab_count", "v_observation", LAB),
        _chart_count("claim_count", "v_claim"),
        _chart_count("line_count", "v_claim_line"),
        _chart("claim_on_encounter", "v_claim_encounter", "service_ts", "claim_id", "diagnosis_1", "service_ts, claim_id", 1),
        _chart("coverage", "v_coverage", "start_ts", "payer_id", "payer_name", "start_ts, payer_id, end_ts, member_id"),
    ]),
}
CHART = "patient_id, panel, position, moment, code, label"


@query(f"SELECT {CHART} FROM v_chart", CHART_VIEWS)
def member_chart(spark: SparkSession, folder: str) -> DataFrame:
    """The ten panels of every member, each row with its place."""
    return M.chart(Source(spark, folder).core())


@query(
    f"""SELECT {CHART} FROM v_chart WHERE patient_id = (
            SELECT patient_id FROM v_encounter GROUP BY 1 ORDER BY COUNT(*) DESC, patient_id LIMIT 1)""",
    CHART_VIEWS,
)
def one_member_chart(spark: SparkSession, folder: str) -> DataFrame:
    """The chart of the member with the most encounters, from charts of all members dealt out by member."""
    core = Source(spark, folder).core()
    path = scratch_path(spark, "charts")
    M.write_by_member(M.chart(core), path, tasks=core.tasks)
    busiest = core["encounter"].groupBy("patient_id").count().orderBy(F.desc("count"), "patient_id").first()
    return M.read_member(spark, path, busiest["patient_id"])


@query(
    """SELECT p.patient_id, first_name, last_name, encounter_id, code, start_ts AS "start", description
       FROM v_patient p JOIN v_medication m ON m.patient_id = p.patient_id"""
)
def named_medications(spark: SparkSession, folder: str) -> DataFrame:
    """Every medication with the name of its member."""
    return M.named_medications(Source(spark, folder).core())


COMMON = """(SELECT p.first_name, p.last_name, m.code, p.patient_id FROM v_patient p
             JOIN v_medication m ON m.patient_id = p.patient_id
             GROUP BY 1, 2, 3, 4 ORDER BY COUNT(*) DESC, p.patient_id, m.code LIMIT 1)"""


@query(
    f"""SELECT p.patient_id, p.first_name, p.last_name, p.birthdate, m.encounter_id, m.code, m.start_ts AS "start"
        FROM v_patient p JOIN v_medication m ON m.patient_id = p.patient_id
        JOIN {COMMON} c ON c.first_name = p.first_name AND c.last_name = p.last_name AND c.code = m.code"""
)
def medication_by_name_and_code(spark: SparkSession, folder: str) -> DataFrame:
    """The member looked up by both names, and the medications of one code: of whom and which most rows tell."""
    core = Source(spark, folder).core()
    often = M.named_medications(core).groupBy("first_name", "last_name", "code", "patient_id").count()
    one = often.orderBy(F.desc("count"), "patient_id", "code").first()
    member = M.members_named(core, one["first_name"], one["last_name"]).select("patient_id", "birthdate")
    rows = M.named_medications(core, one["first_name"], one["last_name"], one["code"])
    return rows.join(member, "patient_id").drop("description")
