"""List answers meet their questions where they lie, and claims are searched in leaps."""

import random
import re

from pyspark.sql import functions as F

from citedspark import fixed_values as fv
from citedspark.functions import text as X
from citedspark.plans import answers as A
from citedspark.plans import questions as Q
from test_answers import ALLERGY, P, core  # noqa: F401


def claims(text):
    rest = text.lower()
    for negation in fv.ALLOWED_NEGATIONS:
        rest = rest.replace(negation, "")
    return any(claim in rest for claim in fv.BANNED_CLAIMS)


def test_claims_after_negations(spark):
    rng = random.Random(4)
    pieces = [*fv.BANNED_CLAIMS, *fv.ALLOWED_NEGATIONS, "you ", "should", "not ", "NOT FOR CARE", " ", "increase the ", "dose", "é\n", "validated "]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 6))) for _ in range(600)]
    for claim in fv.BANNED_CLAIMS:  # a negation may also stand inside of a claim
        texts += [claim.upper(), f"{claim[:3]}{rng.choice(fv.ALLOWED_NEGATIONS)}{claim[3:]}", f"x{claim}"]
    frame = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select("t", X.has_banned_claim(F.col("t")).alias("found"))
    wanted = [None if t is None else claims(t) for t in [*texts, None]]
    assert [r["found"] for r in frame.collect()] == wanted and {True, False} <= set(wanted)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert " replace(" not in plan and "regexp_replace" in plan


def test_list_answers_are_not_sent_to_their_questions(spark, core):  # noqa: F811
    rows = [("1", ALLERGY, P), ("2", "Show this member's medication list with source evidence.", P), ("3", "Tell me", None), ("4", "", P)]
    asked = Q.resolved(Q.screened(spark.createDataFrame(rows, "question_id string, question string, selected_patient_id string")), core)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = A.answered(asked, core)
        plan = found._jdf.queryExecution().executedPlan().toString()
        of_lists = re.findall(r"Exchange hashpartitioning\(intent#\d+, patient_id#\d+, \d+\)", plan)
        # The lines of list answers and the questions, each once; the answers are not dealt out again.
        assert len(of_lists) == 2
        assert {r["question_id"] for r in found.collect()} == {"1", "2", "3", "4"}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
