"""Screening of questions, and text functions over the given texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citedspark import fixed_values as fv
from citedspark.functions import text as X
from citedspark.plans import questions as Q
from workload.questions_source import SQL_VIEWS, all_questions
from workload.registry import query
from workload.tables import Source


def _lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _found(pattern: str, column: str = "q") -> str:
    return f"regexp_matches({column}, {_lit('(?i)' + pattern)})"


CHANGE = (
    f"({_found(fv.NEW_PRESCRIPTION_PATTERN)} OR {_found(fv.START_MEDICATION_PATTERN)} OR ({_found(fv.MEDICATION_CHANGE_VERB)} "
    f"AND {_found(fv.MEDICATION_CHANGE_OBJECT)}))"
)
HITS = (CHANGE, _found(fv.DISCHARGE_PATTERN), _found(fv.EXTERNAL_PATTERN), _found(fv.TREATMENT_PATTERN))
SQUEEZED = r"trim(regexp_replace(question, '\s+', ' ', 'g'))"
REFUSAL_LIST = "list_filter([" + ", ".join(
    f"CASE WHEN {hit} THEN '{name}' END" for name, hit in zip(fv.REFUSALS, HITS)
) + "], lambda x: x IS NOT NULL)"
INTENT = "CASE WHEN len(refusals) > 0 THEN refusals[1] " + " ".join(
    f"WHEN {_found(pattern)} THEN '{name}'" for name, pattern in fv.ANSWER_INTENTS
) + " ELSE 'no_citation' END"
PERSON = r"'\b([A-Za-z]+[0-9]+)\s+([A-Za-z]+[0-9]+)\b'"
LONG = r"'(?i)\b(\d{1,2})\s+(" + "|".join(fv.MONTHS) + r")\s+(\d{4})\b'"
MONTH_NUMBER = "CASE lower(regexp_extract(question, " + LONG + ", 2)) " + " ".join(
    f"WHEN '{name}' THEN '{number:02d}'" for number, name in enumerate(fv.MONTHS, 1)
) + " END"
VIEWS = {
    **SQL_VIEWS,
    "v_screened": f"""
        SELECT *, {INTENT} AS intent,
               NULLIF(regexp_extract(question, {PERSON}, 1), '') AS named_first,
               NULLIF(regexp_extract(question, {PERSON}, 2), '') AS named_last,
               COALESCE(NULLIF(regexp_extract(question, '\\b(\\d{{4}}-\\d{{2}}-\\d{{2}})\\b', 1), ''),
                   CASE WHEN regexp_matches(question, {LONG}) THEN
                       regexp_extract(question, {LONG}, 3) || '-' || {MONTH_NUMBER} || '-'
                       || lpad(regexp_extract(question, {LONG}, 1), 2, '0') END) AS named_day
        FROM (SELECT *, {REFUSAL_LIST} AS refusals
              FROM (SELECT *, {SQUEEZED} AS q FROM v_question))""",
}


@query(
    """SELECT question_id, intent, array_to_string(refusals, ',') AS refusals, named_first, named_last, named_day
       FROM v_screened""",
    VIEWS,
)
def question_intents(spark: SparkSession, folder: str) -> DataFrame:
    return Q.screened(all_questions(Source(spark, folder))).select(
        "question_id", "intent", F.array_join("refusals", ",").alias("refusals"),
        "named_first", "named_last", "named_day",
    )


@query(
    "SELECT question_id, array_to_string(list_transform(refusals, lambda x: CASE x "
    + " ".join(f"WHEN '{name}' THEN {_lit(fv.REFUSAL_TEXT[name])}" for name in fv.REFUSALS)
    + " END), ' ') AS refusal FROM v_screened WHERE len(refusals) > 0",
    VIEWS,
)
def refusal_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The combined message of every refused question."""
    asked = Q.screened(all_questions(Source(spark, folder))).filter(F.size("refusals") > 0)
    return asked.select("question_id", X.refusal_text(F.col("refusals")).alias("refusal"))


@query(
    "SELECT question_id, CASE WHEN len(refusals) > 0 THEN '' WHEN intent = 'risk_cohort' THEN 'risk' "
    "WHEN named_first IS NULL AND COALESCE(selected_patient_id, '') = '' THEN '' "
    + " ".join(
        f"WHEN intent = '{intent}' THEN (CASE WHEN named_first IS NOT NULL THEN 'patient_name,' ELSE '' END) "
        f"|| '{','.join(steps)}'"
        for intent, steps in fv.RETRIEVAL_STEPS.items()
        if intent != "risk_cohort"
    )
    + " ELSE '' END AS steps FROM v_screened",
    VIEWS,
)
def retrieval_plan(spark: SparkSession, folder: str) -> DataFrame:
    planned = Q.retrieval_plan(Q.screened(all_questions(Source(spark, folder))))
    return planned.select("question_id", F.array_join("steps", ",").alias("steps"))


@query(
    """SELECT s.question_id, CASE WHEN s.named_first IS NOT NULL THEN n.patient_id
                                  ELSE s.selected_patient_id END AS patient_id
       FROM v_screened s
       LEFT JOIN (SELECT first_name, last_name, CASE WHEN COUNT(*) = 1 THEN MIN(patient_id) END AS patient_id
                  FROM v_patient GROUP BY 1, 2) n ON n.first_name = s.named_first AND n.last_name = s.named_last""",
    VIEWS,
)
def member_resolution(spark: SparkSession, folder: str) -> DataFrame:
    source = Source(spark, folder)
    return Q.resolved(Q.screened(all_questions(source)), source.core()).select("question_id", "patient_id")


RUNS = r"list_distinct(list_filter(regexp_extract_all({0}, '\d{{6,18}}'), lambda x: length(x) < 12))"


@query(
    "SELECT 'd' || doc_id AS id, array_to_string(list_sort(" + RUNS.format('"text"') + "), ',') AS codes FROM documents "
    "UNION ALL SELECT 'p' || page_id, array_to_string(list_sort(" + RUNS.format("url || html") + "), ',') FROM pages"
)
def code_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Digit runs that can be codes, in every document and page."""
    source = Source(spark, folder)

    def codes(df: DataFrame, key, text) -> DataFrame:
        return df.select(key.alias("id"), F.array_join(F.array_sort(X.code_runs(text)), ",").alias("codes"))

    return codes(
        source.table("documents"), F.concat(F.lit("d"), F.col("doc_id")), F.col("text")
    ).unionByName(
        codes(source.table("pages"), F.concat(F.lit("p"), F.col("page_id")), F.concat("url", "html"))
    )


@query(
    "SELECT patient_id, encounter_id, code, array_to_string(list_sort(list_filter("
    + RUNS.format("code || ' ' || (600000000 + CAST(encounter_id AS BIGINT)) || ' ' || description || code")
    + ", lambda x: x <> code)), ',') AS conflicting FROM v_encounter"
)
def conflicting_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Codes beside the quoted one among three candidate texts of every encounter."""
    encounters = Source(spark, folder).encounter()
    other = (F.lit(600000000) + F.col("encounter_id").cast("bigint")).cast("string")
    candidates = F.array(F.col("code"), other, F.concat("description", "code"))
    return encounters.select(
        "patient_id", "encounter_id", "code",
        F.array_join(F.array_sort(X.conflicting_codes(F.col("code"), candidates)), ",").alias("conflicting"),
    )


BANNED = "lower(t)"
for _phrase in fv.ALLOWED_NEGATIONS:
    BANNED = f"replace({BANNED}, {_lit(_phrase)}, '')"
CLAIM_TEXTS = """
    SELECT 'd' || doc_id || '-' || k.no AS id,
           left("text", 200) || ' ' || k.claim || ' ' || "text" AS t
    FROM documents CROSS JOIN (VALUES {values}) AS k(no, claim)"""
CLAIMS = (
    "This is not a validated stratifier.",
    "This is a validated stratifier.",
    "Not a care recommendation, but I recommend rest.",
    "NOT FOR CARE",
    "We do not say you should; this does not change a dose.",
    "It would increase the dose.",
)


@query(
    "SELECT id, (" + " OR ".join(f"contains(b, {_lit(phrase)})" for phrase in fv.BANNED_CLAIMS)
    + f") AS banned FROM (SELECT id, {BANNED} AS b FROM ("
    + CLAIM_TEXTS.format(values=", ".join(f"({i}, {_lit(c)})" for i, c in enumerate(CLAIMS)))
    + "))"
)
def banned_claims(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with each of six claims put into it."""
    claims = F.array(*[F.lit(c) for c in CLAIMS])
    texts = Source(spark, folder).table("documents").select(
        "doc_id", "text", F.posexplode(claims).alias("no", "claim")
    )
    whole = F.concat_ws(" ", F.substring("text", 1, 200), "claim", "text")
    return texts.select(
        F.concat(F.lit("d"), F.col("doc_id"), F.lit("-"), F.col("no")).alias("id"),
        X.has_banned_claim(whole).alias("banned"),
    )
