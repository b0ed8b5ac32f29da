"""Questions derived from the given tables: per member, per order, and real user turns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workload.tables import Source, joined, text

# Asked about every member; {name} is the member's own name, otherwise the member is selected.
TEMPLATES = (
    "Show this member's chart summary and recent encounters.",
    "Which conditions are recorded for this member, and where are they written?",
    "Show this member's medication list with source evidence.",
    "Show the care plans for this member with cited evidence.",
    "What are this member's latest laboratory results?",
    "Which procedures are recorded for this member?",
    "Which immunizations are recorded for this member?",
    "Show claims tied to encounters for this member.",
    "Show payer coverage spans for this member.",
    "Which antihistamine is on {name}'s medication list, and where is it written?",
    "How many patients in the frozen 2023 cohort had an encounter, and how did the point count sort them?",
    "Change the fexofenadine dose.",
    "Quote the 2019  discharge summary.",
    "What does the openFDA label say?",
    "What do the external claims show?",
    "What should we do about this patient?",
    "Please write a new prescription, and quote the progress note and the drug label.",
    "Tell me something",
    "   ",
    "Which allergy is recorded for this member?",
)
MONTH_NAMES = (
    "January February March April May June July August September October November December".split()
)


def member_questions(source: Source) -> DataFrame:
    texts = F.array(*[F.lit(t) for t in TEMPLATES])
    name = joined("Customer", F.col("c_custkey"), " Nation", F.col("c_nationkey"))
    return (
        source.table("customer")
        .select("c_custkey", name.alias("name"), F.posexplode(texts).alias("no", "template"))
        .select(
            joined("C", F.col("c_custkey"), "-", F.col("no")).alias("question_id"),
            F.replace("template", F.lit("{name}"), F.col("name")).alias("question"),
            F.when(~F.col("template").contains("{name}"), text("c_custkey")).alias("selected_patient_id"),
        )
    )


def order_questions(source: Source) -> DataFrame:
    """An allergy question for the day of every order, in one of the two date forms."""
    day = F.col("o_orderdate")
    month = F.element_at(F.array(*[F.lit(m) for m in MONTH_NAMES]), F.month(day))
    long_form = joined(F.dayofmonth(day), " ", month, " ", F.year(day))
    shown = F.when(F.col("o_orderstatus") == "F", F.date_format(day, "yyyy-MM-dd")).otherwise(long_form)
    return source.table("orders").select(
        joined("O", F.col("o_orderkey")).alias("question_id"),
        joined("What allergy is recorded for that patient on ", shown, "?").alias("question"),
        text("o_custkey").alias("selected_patient_id"),
    )


def user_turns(source: Source) -> DataFrame:
    return (
        source.table("conversations")
        .filter(F.col("role") == "user")
        .select(
            joined("T", F.col("conv_id"), "-", F.col("turn")).alias("question_id"),
            F.col("text").alias("question"),
            F.lit(None).cast("string").alias("selected_patient_id"),
        )
    )


def all_questions(source: Source) -> DataFrame:
    return (
        member_questions(source).unionByName(order_questions(source)).unionByName(user_turns(source))
    )


def _sql(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


SQL_VIEWS = {
    "v_member_question": f"""
        SELECT 'C' || c_custkey || '-' || t.no AS question_id,
               replace(t.template, '{{name}}', 'Customer' || c_custkey || ' Nation' || c_nationkey) AS question,
               CASE WHEN NOT contains(t.template, '{{name}}') THEN CAST(c_custkey AS VARCHAR) END
                   AS selected_patient_id,
               c_custkey, c_nationkey, t.no
        FROM customer CROSS JOIN (VALUES {', '.join(f'({i}, {_sql(t)})' for i, t in enumerate(TEMPLATES))})
             AS t(no, template)""",
    "v_order_question": """
        SELECT 'O' || o_orderkey AS question_id,
               'What allergy is recorded for that patient on '
               || CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%d')
                       ELSE day(o_orderdate) || ' ' || monthname(o_orderdate) || ' ' || year(o_orderdate) END
               || '?' AS question,
               CAST(o_custkey AS VARCHAR) AS selected_patient_id
        FROM orders""",
    "v_question": """
        SELECT question_id, question, selected_patient_id FROM v_member_question
        UNION ALL SELECT question_id, question, selected_patient_id FROM v_order_question
        UNION ALL SELECT 'T' || conv_id || '-' || turn, "text", NULL FROM conversations WHERE role = 'user'""",
}
