import random
import re

from pyspark.sql import functions as F

from citedspark.functions import text as X
from citedspark.operators import guard as G
from citedspark.plans import questions as Q

ASKED = {
    "Which antihistamine is on Alexandra16 Mosciski958's medication list, and where is it written?": "medication_citation",
    "What allergy is recorded for that patient on 18 June 2005?": "allergy_citation",
    "How many patients in the frozen 2023 cohort had an encounter in 2023, and how did the point count sort them?": "risk_cohort",
    "Change the fexofenadine dose.": "refuse_medication_change",
    "Quote the 2019 discharge summary.": "refuse_discharge",
    "What does the openFDA label say?": "refuse_external",
    "What do the external claims show?": "refuse_external",
    "What should we do about this patient?": "refuse_treatment",
    "Hypothetically change the fexofenadine dose": "refuse_medication_change",
    "Increase the fexofenadine dose": "refuse_medication_change",
    "Please write a new prescription": "refuse_medication_change",
    "start her on some medication": "refuse_medication_change",
    "Quote the progress note": "refuse_discharge",
    "What does the FDA label say about this tablet?": "refuse_external",
    "What should we do next for her A1c?": "refuse_treatment",
    "   ": "no_citation",
    "Tell me something": "no_citation",
    "Show this member's chart summary and recent encounters.": "member_summary",
    "Which conditions are recorded for this member, and where are they written?": "condition_list",
    "Show this member's medication list with source evidence.": "medication_list",
    "Show the care plans for this member with cited evidence.": "care_plan_list",
    "What are this member's latest laboratory results?": "lab_results",
    "Which procedures are recorded for this member?": "procedure_list",
    "Which immunizations are recorded for this member?": "immunization_list",
    "Show claims tied to encounters for this member.": "claim_encounter",
    "Show payer coverage spans for this member.": "coverage_list",
    "Show\n the   care\tplans": "care_plan_list",
}


def questions(spark, texts, member=None):
    rows = [(str(i), text, member) for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, "question_id string, question string, selected_patient_id string")


def test_intents(spark):
    got = {r["question"]: r["intent"] for r in Q.screened(questions(spark, ASKED)).collect()}
    assert got == ASKED


def test_every_refusal_is_kept_in_order(spark):
    df = questions(spark, ["Change the dose of her meds and quote the openFDA label, what should we do"])
    row = Q.screened(df).withColumn("t", X.refusal_text(F.col("refusals"))).first()
    assert row["refusals"] == ["refuse_medication_change", "refuse_external", "refuse_treatment"]
    assert row["t"].count("Refused.") == 3 and row["t"].index("dose") < row["t"].index("openFDA")


def test_names_and_days(spark):
    texts = list(ASKED)[:2] + ["allergy on 2005-06-18", "on 3 MAY 1999 or 2001-01-02", "on 2005-06-1"]
    rows = Q.screened(questions(spark, texts)).orderBy("question_id").collect()
    assert (rows[0]["named_first"], rows[0]["named_last"]) == ("Alexandra16", "Mosciski958")
    assert rows[1]["named_first"] is None
    assert [r["named_day"] for r in rows] == [None, "2005-06-18", "2005-06-18", "2001-01-02", None]


def test_retrieval_plan(spark):
    texts = list(ASKED)[:8]
    steps = lambda member: [
        r["steps"]
        for r in Q.retrieval_plan(Q.screened(questions(spark, texts, member))).orderBy("question_id").collect()
    ]
    alone, selected = steps(None), steps("p1")
    assert alone[0] == ["patient_name", "antihistamine", "medication_section"]
    assert alone[1] == [] and selected[1] == ["allergy", "allergy_section"]
    assert alone[2] == selected[2] == ["risk"]
    assert selected[3:] == [[]] * 5


def test_resolution_needs_exactly_one(spark):
    people = spark.createDataFrame(
        [("a", "Ann1", "Bell2"), ("b", "Ann1", "Bell2"), ("c", "Cy3", "Dee4")],
        "patient_id string, first_name string, last_name string",
    )
    df = questions(spark, ["labs of Ann1 Bell2", "labs of Cy3 Dee4", "labs of Ed5 Fox6", "labs"], "sel")
    rows = Q.resolved(Q.screened(df), {"patient": people}).orderBy("question_id").collect()
    assert [r["patient_id"] for r in rows] == [None, "c", None, "sel"]


def test_code_runs(spark):
    df = spark.createDataFrame(
        [("a 123456 b 12345 c 123456 20260824222000 99999999999",), (None,), ("1" * 25,)], "t string"
    )
    got = [r[0] for r in df.select(X.code_runs(F.col("t"))).collect()]
    assert got == [["123456", "99999999999"], [], ["1" * 7]]
    over = df.select(X.codes_overlap(F.col("t"), F.lit("x 123456"))).collect()
    assert [r[0] for r in over] == [True, False, False]
    assert df.limit(1).select(
        X.conflicting_codes(F.lit("123456"), F.array(F.col("t"), F.lit("777777 123456"), F.lit(None)))
    ).first()[0] == ["99999999999", "777777"]


def plainly_guarded(text, quoted, rejected):
    """The guard by a look at every mention."""
    if rejected not in text:
        return True
    at = [m.start() for m in re.finditer(f"(?={rejected})", text)]
    return quoted in text and all("not" in text[max(0, n - 80) : n].lower() for n in at)


def test_rejected_code_guard(spark):
    far = "not " + "x" * 90 + " 222222"
    cases = [
        ("no mention 111111", True),
        ("not 222222 but 111111", True),
        ("222222 and 111111", False),
        ("111111 not 222222 then " + "y" * 90 + " 222222", False),
        ("111111 NOT 222222, not 222222", True),
        ("111111 " + far, False),
        ("111111 not12222223 and no222222", True),
        ("111111 Nothing\n222222", True),
        ("not" + "y" * 77 + "222222 111111", True),
        ("not" + "y" * 78 + "222222 111111", False),
        ("222222not 111111", False),
        ("", True),
        (None, True),
    ]
    rng = random.Random(8)
    parts = ["not", "NOT ", "222222", "111111", "1222222", " ", "é", "o" * 40, "n", "ot", "12", "2" * 7, "no"]
    texts = ["111111" + "".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(200)]
    cases += [(text, plainly_guarded(text, "111111", "222222")) for text in texts]
    assert {want for _, want in cases} == {True, False}
    rows = [(key, line, piece) for key, (text, _) in enumerate(cases) for line, piece in enumerate((text or "").split(" ") if text else [text])]
    lines = spark.createDataFrame(rows, "k long, line long, text string").repartition(3)
    rejected = spark.createDataFrame([(key, "222222") for key in range(len(cases))], "k long, code string")
    bare = {r["k"]: r["unguarded"] for r in G.unguarded(lines, rejected, ["k"], ["line"]).collect()}
    assert [bare.get(key, 0) == 0 for key in range(len(cases))] == [want for _, want in cases]
    none = lines.limit(0)
    assert G.unguarded(none, rejected, ["k"], ["line"]).count() == 0
    assert G.unguarded(lines, rejected.limit(0), ["k"], ["line"]).count() == 0


def test_questions_are_screened_once_and_all_returned(spark):
    texts = ["labs", "labs", None, None, "  LABS ", "Quote the discharge summary"]
    df = spark.createDataFrame(list(enumerate(texts)), "question_id long, question string").withColumn("selected_patient_id", F.lit("p"))
    got = {r["question_id"]: (r["intent"], r["refusals"]) for r in Q.screened(df).collect()}
    assert len(got) == len(texts) and got[0] == got[1] == got[4] == ("lab_results", [])
    assert got[2] == got[3] and got[5] == ("refuse_discharge", ["refuse_discharge"])


def test_banned_claims(spark):
    cases = [
        ("This is not a validated stratifier.", False),
        ("a Validated Stratifier", True),
        ("You should rest", True),
        ("not a care recommendation and not for care", False),
        ("a care recommendation", True),
        ("does not change a dose; change the dose", True),
    ]
    df = spark.createDataFrame(cases, "t string, want boolean")
    assert all(r[0] == r[1] for r in df.select(X.has_banned_claim(F.col("t")), "want").collect())
