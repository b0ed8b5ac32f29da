"""Cited answers for a table of questions, or refusals.

List answers depend only on the member and the class of question, so they are built once
per member and then joined to the questions: a member asked about in very many questions
costs nothing extra. Answers that cite one row may cite any number of document cells; the
answer holds them all, and `answer_rows` gives them as rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citedspark import fixed_values as fv
from citedspark.functions import text as X
from citedspark.functions.citations import citation, problems, rendered, rendered_kind
from citedspark.functions.columns import down, tidy, up
from citedspark.operators.ranking import top_rows
from citedspark.plans import answer_rows as R
from citedspark.plans import member as M
from citedspark.plans.answer_rows import cell_codes
from citedspark.plans.conform import Core
from citedspark.plans.wording import blank, filled, said, sentence
from citedspark.session import written

MEMBER = "patient_id"

def no_codes() -> Column:
    return F.array().cast("array<string>")


def _section_of(intent: str) -> str:
    return next(
        (fv.SECTION_OF_STEP[step] for step in fv.RETRIEVAL_STEPS[intent] if step in fv.SECTION_OF_STEP), ""
    )


# --- evidence match -----------------------------------------------------------
def evidence_match(rows: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of the same member that share a code run with a row; each cell once per row.

    `rows` has the keys (patient_id among them), section_loinc and code.
    """
    wanted = rows.select(*keys, "section_loinc", F.explode(X.code_runs(F.col("code"))).alias("run"))
    return (
        wanted.join(cell_codes(cells), [MEMBER, "section_loinc", "run"])
        .groupBy(*keys, "section_loinc", "document_id", "element_id")
        .agg(F.min("text").alias("text"))
    )


def _first_cells(rows: DataFrame, cells: DataFrame, keys: list[str], count: int) -> DataFrame:
    """The first cells per row. A member shows a few rows a class, so each cell meets a few rows."""
    wanted = rows.select(*keys, "section_loinc", F.explode(X.code_runs(F.col("code"))).alias("run"))
    near = (
        wanted.join(cell_codes(cells), [MEMBER, "section_loinc", "run"])
        .groupBy(*keys, "section_loinc", "document_id", "element_id").agg(F.min("text").alias("text"))
    )
    order = [up("element_id"), up("document_id")]
    return top_rows(near, keys, order, count, "sub")


# --- list answers, per member -------------------------------------------------
def _line(intent: str, df: DataFrame, text: Column, cite: Column, incomplete: Column) -> DataFrame:
    return df.select(
        F.lit(intent).alias("intent"), MEMBER, "position", F.lit(0).alias("sub"), text.alias("text"),
        cite.alias("citation"), incomplete.alias("incomplete"),
    )


#: List class -> view, start column, the id that ends its order.
_STACKED = {
    "condition_list": ("condition", "start_date", "encounter_id"),
    "medication_list": ("medication", "start_ts", "encounter_id"),
    "care_plan_list": ("careplan", "start_date", "careplan_id"),
    "procedure_list": ("procedure", "start_ts", "encounter_id"),
    "immunization_list": ("immunization", "immunization_ts", "encounter_id"),
}


def evidence_rows(core: Core, members: DataFrame, intents: tuple[str, ...], count: int = 10) -> DataFrame:
    """The first rows of each class and member: open spans first where spans end, then the newest.

    The classes are stacked with their order as columns, so all of them share one window.
    """

    def stacked(intent: str) -> DataFrame:
        view, start, last = _STACKED[intent]
        closed = F.col("stop_date").isNotNull() if intent == "condition_list" else F.lit(False)
        return core[view].select(
            F.lit(intent).alias("intent"), MEMBER, closed.alias("_closed"),
            F.col(start).cast("timestamp_ntz").alias("_start"), F.col(last).alias("_last"),
            # A care plan has an id of its own, which ends its order.
            (F.lit(None).cast("long") if last == "careplan_id" else F.col("source_file_row_number")).alias("_row"),
            "encounter_id", "code",
            F.col(start).cast("string").alias("start"), "description",
        )

    rows = reduce(DataFrame.unionByName, [stacked(intent) for intent in intents])
    order = [F.col("_closed").asc(), down("_start"), up("code"), up("_last"), up("_row")]
    wanted = rows.join(members.select(MEMBER), MEMBER, "left_semi")
    return top_rows(wanted, ["intent", MEMBER], order, count).drop("_closed", "_start", "_last", "_row")


def _clinical_lines(core: Core, members: DataFrame, intents: tuple[str, ...]) -> DataFrame:
    # Written once: the rows' own lines and their cells both read them, with other columns.
    rows = written(evidence_rows(core, members, intents).select(
        "intent",
        _by_intent({intent: F.lit(_section_of(intent)) for intent in intents}).alias("section_loinc"),
        _by_intent({intent: F.lit(fv.CLINICAL_LISTS[intent][0]) for intent in intents}).alias("table"),
        MEMBER, "position",
        *[tidy(F.col(name)).alias(name) for name in ("encounter_id", "code", "start", "description")],
    ), "evidence")
    cite = {name: F.col(name) for name in ("table", MEMBER, "encounter_id", "code", "start")}
    own = rows.select(
        "intent", MEMBER, "position", F.lit(0).alias("sub"),
        sentence(
            said(F.col("description"), "description not recorded"),
            "; code ", said(F.col("code"), "not recorded"),
            "; start ", said(F.col("start"), "not recorded"),
            ". ", rendered_kind("table", **cite), ".",
        ).alias("text"),
        citation("table", **cite).alias("citation"),
        reduce(
            lambda a, b: a | b, [blank(F.col(name)) for name in (MEMBER, "encounter_id", "code", "start")]
        ).alias("incomplete"),
    )
    shown = rows.filter(F.col("position") <= fv.DISPLAYED_ROWS)
    # The rows are those of the members already, so the cells meet them only once.
    cells = core["document_section"].filter(F.col("section_loinc").isin(*[_section_of(intent) for intent in intents]))
    keys = ["intent", MEMBER, "position"]
    document = {name: F.col(name) for name in ("document_id", "section_loinc", "element_id")}
    evidence = tidy(F.col("text"))
    attached = _first_cells(shown, cells, keys, fv.DISPLAYED_CELLS).select(
        *keys, "sub",
        sentence(
            F.coalesce(F.concat(F.lit("C-CDA evidence: "), evidence), F.lit("C-CDA evidence")),
            ". ", rendered_kind("document", **document), ".",
        ).alias("text"),
        citation("document", **document).alias("citation"),
        F.lit(False).alias("incomplete"),
    )
    return own.unionByName(attached)


def _lab_lines(core: Core, members: DataFrame) -> DataFrame:
    df = M.panel(core, "lab_evidence", members=members)
    cite = {
        "table": F.lit("OBSERVATION"), MEMBER: F.col(MEMBER),
        **{name: tidy(F.col(name)) for name in ("row_id", "code", "observed_at")},
    }
    text = sentence(
        said(F.col("description"), "description not recorded"), ": ",
        said(F.col("value"), "value not recorded"), " ", said(F.col("units"), ""),
        " on ", said(F.col("observed_at"), "date not recorded"), ". ",
        rendered_kind("observation", **cite), ".",
    )
    return _line("lab_results", df, text, citation("observation", **cite), F.lit(False))


def _claim_lines(core: Core, members: DataFrame) -> DataFrame:
    df = M.claim_evidence(core, members=members)
    cite = {
        "table": F.lit("CLAIM"), MEMBER: F.col(MEMBER),
        **{name: tidy(F.col(name)) for name in ("claim_id", "encounter_id", "service_date")},
    }
    text = sentence(
        "Claim ", said(F.col("claim_id"), "not recorded"),
        " is tied to encounter ", said(F.col("encounter_id"), "not recorded"),
        " on ", said(F.col("service_date"), "date not recorded"),
        "; class ", said(F.col("encounter_class"), "not recorded"), ". ",
        rendered_kind("claim", **cite), ".",
    )
    return _line("claim_encounter", df, text, citation("claim", **cite), F.lit(False))


def _coverage_lines(core: Core, members: DataFrame) -> DataFrame:
    df = M.panel(core, "coverage_evidence", members=members)
    cite = {
        "table": F.lit("MEMBER_COVERAGE"), MEMBER: F.col(MEMBER),
        **{name: tidy(F.col(name)) for name in ("payer_id", "start", "end")},
    }
    text = sentence(
        said(F.col("payer_name"), "payer name not recorded"),
        " from ", said(F.col("start"), "start not recorded"),
        " to ", said(F.col("end"), "end not recorded"),
        "; member id ", said(F.col("member_id"), "blank in source"), ". ",
        rendered_kind("coverage", **cite), ".",
    )
    return _line("coverage_list", df, text, citation("coverage", **cite), F.lit(False))


def _summary_lines(core: Core, members: DataFrame) -> DataFrame:
    patients = core["patient"].join(members.select(MEMBER), MEMBER, "left_semi")
    cite = {"table": F.lit("PATIENT"), MEMBER: F.col(MEMBER)}
    name = F.nullif(F.concat_ws(" ", tidy(F.col("first_name")), tidy(F.col("last_name"))), F.lit(""))
    profile = _line(
        "member_summary",
        patients.withColumn("position", F.lit(0)),
        sentence(
            F.coalesce(name, F.lit("Selected member")),
            ": gender ", said(F.col("gender"), "not recorded"),
            ", birth ", said(F.col("birthdate"), "not recorded"),
            ", city/state ", said(F.col("city"), "not recorded"), "/", said(F.col("state"), "not recorded"),
            ". ", rendered_kind("patient", **cite), ".",
        ),
        citation("patient", **cite),
        F.lit(False),
    )
    cite = {
        "table": F.lit("ENCOUNTER"), MEMBER: F.col(MEMBER),
        **{key: tidy(F.col(key)) for key in ("encounter_id", "start")},
    }
    recent = _line(
        "member_summary",
        M.panel(core, "recent_encounters", members=members),
        sentence(
            "Encounter ", said(F.col("encounter_class"), "class not recorded"),
            " on ", said(F.col("start"), "date not recorded"),
            ": ", said(F.col("description"), "description not recorded"), ". ",
            rendered_kind("encounter", **cite), ".",
        ),
        citation("encounter", **cite),
        F.lit(False),
    )
    return profile.unionByName(recent)


LIST_INTENTS = (*fv.CLINICAL_LISTS, "lab_results", "claim_encounter", "coverage_list", "member_summary")


def list_lines(core: Core, members: DataFrame, intents: tuple[str, ...] = LIST_INTENTS) -> DataFrame:
    """Evidence lines per class and member: rows (sub 0) and their cells, at most a few each."""
    clinical = tuple(intent for intent in intents if intent in fv.CLINICAL_LISTS)
    parts = [_clinical_lines(core, members, clinical)] if clinical else []
    for intent, build in (
        ("lab_results", _lab_lines),
        ("claim_encounter", _claim_lines),
        ("coverage_list", _coverage_lines),
        ("member_summary", _summary_lines),
    ):
        if intent in intents:
            parts.append(build(core, members))
    return reduce(DataFrame.unionByName, parts)


def _by_intent(values: dict[str, Column]) -> Column:
    result = None
    for intent, value in values.items():
        hit = F.col("intent") == intent
        result = F.when(hit, value) if result is None else result.when(hit, value)
    return result


def _gate(text: Column, citations: Column) -> Column:
    """True when a cited answer may be shown."""
    bad = F.exists(citations, lambda c: F.size(problems(c)) > 0)
    return (F.size(citations) > 0) & ~bad & ~X.has_banned_claim(text)


def list_answers(core: Core, members: DataFrame, intents: tuple[str, ...] = LIST_INTENTS) -> DataFrame:
    """(intent, patient_id, status, text, citations) for members with rows.

    A group holds at most five rows, two cells each, and one profile.
    """
    shown = F.col("position") <= fv.DISPLAYED_ROWS
    grouped = (
        list_lines(core, members, intents)
        .groupBy("intent", MEMBER)
        .agg(
            F.count_if(F.col("sub") == 0).alias("n"),
            F.count_if(F.col("position") == 0).alias("profiles"),
            F.coalesce(F.bool_or(F.when(shown, F.col("incomplete"))), F.lit(False)).alias("incomplete"),
            F.array_sort(
                F.collect_list(F.when(shown, F.struct("position", "sub", "text", "citation")))
            ).alias("lines"),
        )
    )
    few = F.least(F.col("n"), F.lit(fv.DISPLAYED_ROWS))
    header = _by_intent(
        {
            **{
                intent: filled(fv.LIST_HEADER, label=F.lit(label), n=few)
                for intent, (_table, label) in fv.CLINICAL_LISTS.items()
            },
            "lab_results": filled(fv.LAB_HEADER, n=few),
            "claim_encounter": filled(fv.CLAIM_HEADER, n=few),
            "coverage_list": filled(fv.COVERAGE_HEADER, n=few),
        }
    )
    footer = _by_intent(
        {
            **{intent: F.lit(fv.RECORD_FOOTER) for intent in (*fv.CLINICAL_LISTS, "member_summary")},
            "lab_results": F.lit(fv.LAB_FOOTER),
            "coverage_list": F.lit(fv.COVERAGE_FOOTER),
        }
    )
    left = F.when(
        F.col("intent").isin(*fv.CLINICAL_LISTS) & (F.col("n") > fv.DISPLAYED_ROWS),
        filled(fv.NOT_DISPLAYED, n=F.col("n") - fv.DISPLAYED_ROWS),
    )
    text = F.concat_ws(" ", header, F.array_join(F.col("lines.text"), " "), left, footer)
    table = F.create_map(*[F.lit(v) for k, (t, _l) in fv.CLINICAL_LISTS.items() for v in (k, t)])
    refused = (
        F.when((F.col("intent") == "member_summary") & (F.col("profiles") != 1), fv.REFUSAL_TEXT["summary_rows"])
        .when(F.col("incomplete"), filled(fv.REFUSAL_TEXT["bad_row"], table=table[F.col("intent")]))
        .when(~_gate(F.col("full"), F.col("lines.citation")), fv.REFUSAL_TEXT["citation_check"])
    )
    return grouped.withColumn("full", text).withColumn("refused", refused).select(
        "intent",
        MEMBER,
        F.when(F.col("refused").isNull(), "cited").otherwise("refused").alias("status"),
        F.coalesce("refused", "full").alias("text"),
        F.when(F.col("refused").isNull(), F.col("lines.citation")).alias("citations"),
    )


# --- answers that cite one row ------------------------------------------------
def single_answers(core: Core, asked: DataFrame, intents: tuple[str, ...] = R.INTENTS) -> DataFrame:
    """(intent, patient_id, named_day, status, text, citations, codes, cells) of the asked keys that have rows.

    The verdicts come from rows (`answer_rows`); here the lines of an answer are joined to one text,
    which must fit a task. `answer_rows.SingleAnswers.lines` gives the same lines without that bound.
    """
    parts = R.SingleAnswers(core, asked, intents)
    cited = F.col("refusal").isNull()
    units = parts.cells.groupBy(*R.KEYS).agg(
        F.array_sort(F.collect_list(F.struct("element_id", "document_id", "unit", "citation"))).alias("units")
    )
    runs = parts.codes.groupBy(MEMBER).agg(F.array_sort(F.collect_list("run")).alias("runs"))
    others = F.when(
        cited & (F.col("intent") == R.ALLERGY),
        F.array_except(F.coalesce("runs", no_codes()), X.code_runs(F.col("code"))),
    ).otherwise(no_codes())
    joined = (
        parts.heads.join(units, R.KEYS, "left").join(runs, MEMBER, "left")
        .select(*R.KEYS, "refusal", "lead", "units", "code", "cells", others.alias("rejected"),
                R.own_citation().alias("own"), R.note().alias("note"))
    )
    rejected = F.array_join(F.transform("rejected", lambda other: R.rejected_line(F.col("code"), other)), " ")
    text = F.concat_ws(
        " ", "lead", F.array_join(F.col("units.unit"), " "), F.nullif(rejected, F.lit("")), "note", F.lit(fv.RECORD_FOOTER)
    )
    return joined.select(
        *R.KEYS,
        F.when(cited, "cited").otherwise("refused").alias("status"),
        F.when(cited, text).otherwise(F.col("refusal")).alias("text"),
        F.when(cited, F.concat(F.array("own"), F.coalesce(F.col("units.citation"), F.slice(F.array("own"), 1, 0)))).alias("citations"),
        F.when(cited, F.array("code")).otherwise(no_codes()).alias("quoted_codes"),
        F.col("rejected").alias("rejected_codes"),
        "cells",
    )


# --- the cohort answer --------------------------------------------------------
def risk_answer(risk_rows: DataFrame) -> DataFrame:
    """One answer from the score rows: checked, then told; no rows or any doubt is a refusal.

    There is one row per score, so a handful.
    """
    names = (
        "score", "patient_count", "event_rate", "cohort_n", "event_n", "base_rate", "index_date",
        "horizon_end", "ge2_patient_count", "ge2_event_rate", "excluded_dead", "excluded_born",
    )
    present = {name.lower() for name in risk_rows.columns}
    rows = risk_rows.select(
        *[
            (tidy(F.col(name)) if name in present else F.lit(None).cast("string")).alias(name)
            for name in names
        ]
    )
    required = ("score", "patient_count", "cohort_n", "event_n", "base_rate", "index_date", "horizon_end")
    missing = reduce(lambda a, b: a | b, [F.col(name).isNull() for name in required])

    def not_fraction(value: Column) -> Column:
        number = value.try_cast("double")
        return number.isNull() | (number < 0) | (number > 1)

    no_rate = F.col("event_rate").isNull()
    error = (
        F.when(missing, fv.REFUSAL_TEXT["risk_missing"])
        .when(~X.is_whole(F.col("patient_count")), fv.REFUSAL_TEXT["risk_count"])
        .when(no_rate & (X.whole_text(F.col("patient_count")) != "0"), fv.REFUSAL_TEXT["risk_no_rate"])
        .when(~no_rate & not_fraction(F.col("event_rate")), fv.REFUSAL_TEXT["risk_rate"])
        .when(
            ~(X.is_whole(F.col("score")) & X.is_whole(F.col("cohort_n")) & X.is_whole(F.col("event_n"))),
            fv.REFUSAL_TEXT["risk_count"],
        )
        .when(not_fraction(F.col("base_rate")), fv.REFUSAL_TEXT["risk_rate"])
    )

    def disagree(name: str) -> Column:
        return (F.count_distinct(name) != 1) | (F.count(name) != F.count("*"))

    def optional_disagree(name: str) -> Column:
        return (F.count(name) > 0) & disagree(name)

    score = F.col("score").try_cast("double").cast("long")
    patients = X.whole_text(F.col("patient_count"))
    line = F.when(
        no_rate, sentence("Score ", score.cast("string"), ": ", patients, " patients. The retrieved row has no event rate.")
    ).otherwise(
        sentence(
            "Score ", score.cast("string"), ": ", patients, " patients, event rate ",
            X.percent_text(F.col("event_rate").try_cast("double")), ".",
        )
    )
    cite = citation(
        "cohort", table=F.lit(fv.COHORT_TABLE), index_date=F.col("index_date"),
        horizon_end=F.col("horizon_end"), score=score.cast("string"),
    )
    optional = ("ge2_patient_count", "ge2_event_rate", "excluded_dead", "excluded_born")
    total = rows.withColumns(
        {"error": error, "number": score, "line": line, "cite": cite}
    ).agg(
        F.count("*").alias("n"),
        F.min_by("error", F.when(F.col("error").isNotNull(), F.coalesce("number", F.lit(0)))).alias("error"),
        (F.count_distinct("number") != F.count("*")).alias("repeated"),
        (disagree("cohort_n") | disagree("event_n") | disagree("base_rate")).alias("cohort_off"),
        (disagree("index_date") | disagree("horizon_end")).alias("window_off"),
        *[optional_disagree(name).alias(f"{name}_off") for name in optional],
        *[F.min(name).alias(name) for name in names[3:]],
        F.max(F.when(F.col("number") == 1, F.col("event_rate").try_cast("double"))).alias("rate_1"),
        F.max(F.when(F.col("number") == 2, F.col("event_rate").try_cast("double"))).alias("rate_2"),
        F.array_sort(F.collect_list(F.struct("number", "line", "cite"))).alias("lines"),
    )

    def have(*wanted: str) -> Column:
        return reduce(lambda a, b: a & b, [F.col(name).isNotNull() for name in wanted])

    tail, excluded = have("ge2_patient_count", "ge2_event_rate"), have("excluded_dead", "excluded_born")
    refused = F.when(F.col("n") == 0, fv.REFUSAL_TEXT["risk_empty"]).otherwise(F.col("error"))
    refused = F.coalesce(
        refused,
        F.when(F.col("repeated"), fv.REFUSAL_TEXT["risk_repeat"]),
        F.when(F.col("cohort_off"), fv.REFUSAL_TEXT["risk_cohort_disagree"]),
        F.when(F.col("window_off"), fv.REFUSAL_TEXT["risk_window_disagree"]),
        *[
            F.when(F.col(f"{name}_off"), fv.REFUSAL_TEXT["risk_disagree"].format(key=name))
            for name in optional
        ],
        F.when(tail & ~X.is_whole(F.col("ge2_patient_count")), fv.REFUSAL_TEXT["risk_count"]),
        F.when(tail & not_fraction(F.col("ge2_event_rate")), fv.REFUSAL_TEXT["risk_rate"]),
        F.when(
            excluded & ~(X.is_whole(F.col("excluded_dead")) & X.is_whole(F.col("excluded_born"))),
            fv.REFUSAL_TEXT["risk_count"],
        ),
    )
    text = F.concat_ws(
        " ",
        sentence(
            "CORE.RISK_SCORE returned a point count for index ", F.col("index_date"), " through ",
            F.col("horizon_end"), ".",
        ),
        sentence(
            "Cohort size ", X.whole_text(F.col("cohort_n")), ". Events ", X.whole_text(F.col("event_n")),
            ". Base rate ", X.percent_text(F.col("base_rate").try_cast("double")), ".",
        ),
        F.lit(fv.RISK_CAVEAT),
        F.array_join(F.col("lines.line"), " "),
        F.when(F.col("rate_2") < F.col("rate_1"), fv.RISK_BELOW),
        F.when(
            tail,
            sentence(
                "Score 2 or higher: ", X.whole_text(F.col("ge2_patient_count")), " patients, event rate ",
                X.percent_text(F.col("ge2_event_rate").try_cast("double")), ", as returned on the risk rows.",
            ),
        ),
        F.when(
            excluded,
            sentence(
                "Excluded before the cohort, as returned on the risk rows: dead on or before the index ",
                X.whole_text(F.col("excluded_dead")), "; born on or after the index ",
                X.whole_text(F.col("excluded_born")), ".",
            ),
        ),
        F.lit(fv.RISK_FOOTER),
    )
    checked = F.coalesce(
        refused, F.when(~_gate(F.col("full"), F.col("lines.cite")), fv.REFUSAL_TEXT["citation_check"])
    )
    return total.withColumn("full", text).withColumn("_refused", checked).select(
        F.lit("risk_cohort").alias("intent"),
        F.when(F.col("_refused").isNull(), "cited").otherwise("refused").alias("status"),
        F.coalesce("_refused", "full").alias("text"),
        F.when(F.col("_refused").isNull(), F.col("lines.cite")).alias("citations"),
    )


# --- the router ---------------------------------------------------------------
def _counted(citations: Column) -> Column:
    return F.when(citations.isNotNull(), F.size(citations)).cast("long")


def answered(
    resolved_questions: DataFrame, core: Core, risk_rows: DataFrame | None = None, connected: bool = True,
    count_citations: bool = False,
) -> DataFrame:
    """One answer per question.

    With `count_citations` the column `citations` is their number, taken before answers meet questions,
    so that the records do not travel.

    Precedence: refusal, failed query, nothing to cite, no source, cohort, unknown name,
    no member, and then the answer of the class. `query_failed` is an optional column.
    The screened questions are written once: every class of answer reads who is asked about.
    """
    questions = resolved_questions
    if "query_failed" not in questions.columns:
        questions = questions.withColumn("query_failed", F.lit(False))
    questions = written(questions.withColumn("named_day", F.coalesce("named_day", F.lit(""))), "questions")
    usable = questions.filter((F.size("refusals") == 0) & F.col(MEMBER).isNotNull() & F.lit(connected))
    codes = [no_codes().alias("quoted_codes"), no_codes().alias("rejected_codes"), F.lit(0).cast("long").alias("cells")]
    common = ["intent", MEMBER, "status", "text", "citations", "quoted_codes", "rejected_codes", "cells"]
    listing = written(usable.filter(F.col("intent").isin(*LIST_INTENTS)).select(MEMBER).distinct(), "listing")
    listed = list_answers(core, listing).select("*", *codes).select(*common)
    found = single_answers(core, usable).withColumnsRenamed({"named_day": "_day"}).select(*common, "_day")
    if count_citations:
        listed, found = (df.withColumn("citations", _counted(F.col("citations"))) for df in (listed, found))
    # Only the allergy answer depends on the day in the question.
    day = F.when(F.col("intent") == "allergy_citation", F.col("named_day")).otherwise(F.lit(""))
    # Questions about nobody have no answer to meet; joined, they would all share a key.
    someone = F.col(MEMBER).isNotNull()
    is_list = F.coalesce(F.col("intent").isin(*LIST_INTENTS), F.lit(False))
    dated = questions.withColumn("_day", day)
    # List answers lie by class and member already: their texts meet the questions without being sent again.
    joined = (
        dated.filter(someone & is_list).join(listed, ["intent", MEMBER], "left")
        .unionByName(dated.filter(someone & ~is_list).join(found, ["intent", MEMBER, "_day"], "left"))
        .unionByName(dated.filter(~someone), allowMissingColumns=True)
    )
    if risk_rows is not None:
        risk = risk_answer(risk_rows).withColumnsRenamed(
            {"status": "risk_status", "text": "risk_text", "citations": "risk_citations"}
        )
        if count_citations:
            risk = risk.withColumn("risk_citations", _counted(F.col("risk_citations")))
        joined = joined.join(risk, "intent", "left")
    else:
        joined = joined.withColumns(
            {
                "risk_status": F.lit(None).cast("string"),
                "risk_text": F.lit(None).cast("string"),
                "risk_citations": F.lit(None).cast(found.schema["citations"].dataType),
            }
        )
    is_named = F.col("named_first").isNotNull()
    nothing_found = _by_intent(
        {
            **{
                intent: F.lit(fv.REFUSAL_TEXT["no_rows"].format(label=label.lower()))
                for intent, (_table, label) in fv.CLINICAL_LISTS.items()
            },
            "lab_results": F.lit(fv.REFUSAL_TEXT["no_labs"]),
            "claim_encounter": F.lit(fv.REFUSAL_TEXT["no_claims"]),
            "coverage_list": F.lit(fv.REFUSAL_TEXT["no_coverage"]),
            "member_summary": F.lit(fv.REFUSAL_TEXT["summary_rows"]),
            "medication_citation": F.lit(fv.REFUSAL_TEXT["no_medication"]),
            "allergy_citation": F.lit(fv.REFUSAL_TEXT["no_allergy"]),
        }
    )
    is_risk = F.col("intent") == "risk_cohort"
    refused = (
        F.when(F.size("refusals") > 0, X.refusal_text(F.col("refusals")))
        .when(F.col("query_failed"), fv.REFUSAL_TEXT["query_failed"])
        .when(F.col("intent") == fv.NO_CITATION, fv.REFUSAL_TEXT["no_citation"])
        .when(F.lit(not connected), fv.REFUSAL_TEXT["no_source"])
        .when(is_risk & F.col("risk_status").isNull(), fv.REFUSAL_TEXT["risk_empty"])
        .when(is_risk & (F.col("risk_status") == "refused"), F.col("risk_text"))
        .when(is_risk, F.lit(None))
        .when(is_named & F.col(MEMBER).isNull(), fv.REFUSAL_TEXT["name_unmatched"])
        .when(F.col(MEMBER).isNull(), fv.REFUSAL_TEXT["no_member"])
        .when(F.col("status").isNull(), nothing_found)
        .when(F.col("status") == "refused", F.col("text"))
    )
    label = F.when(
        (F.col("intent") == "medication_citation") & is_named,
        sentence(F.col("named_first"), " ", F.col("named_last"), ": "),
    ).otherwise("")
    cited = F.col("_refused").isNull()
    return joined.withColumn("_refused", refused).select(
        "question_id",
        "question",
        MEMBER,
        "intent",
        F.when(cited, "cited").otherwise("refused").alias("status"),
        F.when(~cited, F.col("_refused"))
        .when(is_risk, F.col("risk_text"))
        .otherwise(F.concat(label, F.col("text")))
        .alias("text"),
        F.when(cited & is_risk, F.col("risk_citations")).when(cited, F.col("citations")).alias("citations"),
        cited.alias("narration_allowed"),
        F.when(cited, F.coalesce("quoted_codes", no_codes())).otherwise(no_codes()).alias("quoted_codes"),
        F.when(cited & ~is_risk, F.col("rejected_codes")).otherwise(no_codes()).alias("rejected_codes"),
        F.when(cited, F.coalesce("cells", F.lit(0))).otherwise(0).alias("cells"),
    )


def citation_texts(citations: Column) -> Column:
    return F.transform(F.coalesce(citations, F.expr("slice(citations, 1, 0)")), rendered)
