"""Answers that cite one row, kept as rows: a head for each answer, and its lines.

An answer has the key (intent, patient_id, named_day). Its lines (the lead, the attached cells, the
codes that are not quoted, a note, the footer) are judged one by one: a claim or a bad citation is a
flag of its line, and flags meet in the head by `bool_or`. No answer is one value, so a member may
have any number of cells and codes. `answers.single_answers` joins the lines to a text where
one is wanted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citedspark import fixed_values as fv
from citedspark.functions import text as X
from citedspark.functions.citations import citation, problems, rendered_kind
from citedspark.functions.columns import tidy
from citedspark.operators.guard import code_pieces, unguarded
from citedspark.plans import member as M
from citedspark.plans.conform import Core
from citedspark.plans.wording import blank, filled, sentence
from citedspark.session import written

MEMBER = "patient_id"
KEYS = ["intent", MEMBER, "named_day"]
MEDICATION, ALLERGY = "medication_citation", "allergy_citation"
INTENTS = (MEDICATION, ALLERGY)
LEAD, CELL, REJECTED, NOTE, FOOTER = range(5)
SECTION = {MEDICATION: fv.SECTION_OF_STEP["medication_section"], ALLERGY: fv.SECTION_OF_STEP["allergy_section"]}
DOCUMENT = ("document_id", "section_loinc", "element_id")
OWN = ("table", MEMBER, "encounter_id", "code", "start")


def asked_keys(asked: DataFrame) -> DataFrame:
    """The distinct keys of a table of (intent, patient_id, named_day); only allergies go by day."""
    day = F.when(F.col("intent") == ALLERGY, F.coalesce("named_day", F.lit(""))).otherwise(F.lit(""))
    return asked.where(F.col("intent").isin(MEDICATION, ALLERGY) & F.col(MEMBER).isNotNull()).select(
        "intent", MEMBER, day.alias("named_day")
    ).distinct()


def _lead() -> Column:
    shown = {name: F.col(name) for name in ("code", "start", "encounter_id")}
    own = rendered_kind("table", **{name: F.col(name) for name in OWN})
    medication = filled(fv.MEDICATION_LEAD, description=F.col("description"), citation=own, **shown)
    described = F.coalesce("description", F.lit(fv.NO_DESCRIPTION))
    allergy = filled(fv.ALLERGY_LEAD, description=described, citation=own, **shown)
    return F.when(F.col("intent") == MEDICATION, medication).otherwise(allergy)


def singles(core: Core, keys: DataFrame, intents: tuple[str, ...] = INTENTS) -> DataFrame:
    """Per asked key of the classes with rows: how many rows there are, and of the only one its fields and its lead.

    Rows of members who are not asked about go before they are counted. An allergy counts under
    its day and under no day, so days meet by equality.
    """
    fields = [tidy(F.col(name)).alias(name) for name in ("encounter_id", "code", "start", "description")]

    def counted(rows: DataFrame, intent: str, table: str) -> DataFrame:
        of = rows.withColumn("intent", F.lit(intent)).join(keys, KEYS, "left_semi")
        return of.groupBy(*KEYS).agg(F.count("*").alias("n"), F.min(F.struct(*fields)).alias("row")).select(
            *KEYS, "n", "row.*", F.lit(table).alias("table"), F.lit(SECTION[intent]).alias("section_loinc")
        )

    parts = []
    if MEDICATION in intents:
        parts.append(counted(M.antihistamine_rows(core).withColumn("named_day", F.lit("")), MEDICATION, "MEDICATION"))
    if ALLERGY in intents:
        days = F.explode(F.array(F.lit(""), F.date_format("start", "yyyy-MM-dd")))
        parts.append(counted(M.allergy_rows(core).withColumn("named_day", days), ALLERGY, "ALLERGY"))
    found = reduce(DataFrame.unionByName, parts)
    needed = {MEDICATION: ("encounter_id", "code", "start", "description"), ALLERGY: ("encounter_id", "code", "start")}

    def missing(intent: str) -> Column:
        return (F.col("intent") == intent) & reduce(lambda a, b: a | b, [blank(F.col(name)) for name in (MEMBER, *needed[intent])])

    many = F.col("n") != 1
    refusal = (
        F.when(many & (F.col("intent") == MEDICATION), filled(fv.REFUSAL_TEXT["many_medications"], n=F.col("n")))
        .when(many, filled(fv.REFUSAL_TEXT["many_allergies"], n=F.col("n")))
        .when(missing(MEDICATION), fv.REFUSAL_TEXT["bad_medication"])
        .when(missing(ALLERGY), fv.REFUSAL_TEXT["bad_allergy"])
    )
    return found.withColumn("refusal", refusal).withColumn("lead", F.when(F.col("refusal").isNull(), _lead()))


def own_citation() -> Column:
    return citation("table", **{name: F.col(name) for name in OWN})


# --- posting lists --------------------------------------------------------------
def cell_codes(cells: DataFrame) -> DataFrame:
    """One row per cell and code run found in its code or text; incomplete cells are left out."""
    haystack = F.concat_ws(" ", tidy(F.col("code")), tidy(F.col("text")))
    complete = ~(blank(F.col("document_id")) | blank(F.col("section_loinc")) | blank(F.col("element_id")))
    return cells.filter(complete).select(
        *M.CELL_FIELDS[:-2], "text", F.col("code").alias("cell_code"), F.explode(X.code_runs(haystack)).alias("run")
    )


def postings(rows: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Facts and cells under the (member, section, code run) they share, each once under a run.

    `rows` has the keys (patient_id among them), section_loinc and code. A run that only one side
    holds has no rows. `side` is 'fact' (with the keys) or 'cell' (with document_id, element_id and text).
    """
    place = [MEMBER, "section_loinc", "run"]
    other = [key for key in keys if key != MEMBER]
    facts = rows.select(*keys, "section_loinc", F.explode(X.code_runs(F.col("code"))).alias("run")).distinct()
    own = cell_codes(cells).groupBy(*place, "document_id", "element_id").agg(F.min("text").alias("text"))
    return (
        facts.join(own.select(*place).distinct(), place, "left_semi").select(*place, F.lit("fact").alias("side"), *other)
        .unionByName(
            own.join(facts.select(*place).distinct(), place, "left_semi")
            .select(*place, F.lit("cell").alias("side"), "document_id", "element_id", "text"),
            allowMissingColumns=True,
        )
    )


def cell_lines(core: Core, found: DataFrame, intents: tuple[str, ...] = INTENTS) -> DataFrame:
    """The cells that carry the code of each single row, as lines: unit, citation and whether it claims.

    A medication's cells must also be about it: by code, or by its description in the text.
    """
    one = found.where("refusal IS NULL").select(
        *KEYS, "section_loinc", "code", "description", F.explode(X.code_runs(F.col("code"))).alias("run")
    )
    wanted = core["document_section"].where(F.col("section_loinc").isin(*[SECTION[intent] for intent in intents]))
    about = (F.col("intent") != MEDICATION) | M.about_medication(
        F.col("cell_code"), F.col("text"), F.col("code"), F.col("description")
    )
    matched = (
        one.join(cell_codes(wanted), [MEMBER, "section_loinc", "run"]).where(about)
        .groupBy(*KEYS, *DOCUMENT).agg(F.min("text").alias("text"))
    )
    document = {name: F.col(name) for name in DOCUMENT}
    unit = F.concat_ws(" ", sentence(rendered_kind("document", **document), "."), filled(fv.SECTION_TEXT, text=tidy(F.col("text"))))
    return matched.select(*KEYS, *DOCUMENT, unit.alias("unit"), citation("document", **document).alias("citation")).withColumn(
        "bad", X.has_banned_claim(F.col("unit")) | (F.size(problems(F.col("citation"))) > 0)
    )


def section_codes(core: Core, members: DataFrame) -> DataFrame:
    """Distinct code runs in the allergy section of each member, as rows."""
    cells = core["document_section"].where(F.col("section_loinc") == SECTION[ALLERGY])
    runs = F.array_union(X.code_runs(tidy(F.col("code"))), X.code_runs(tidy(F.col("text"))))
    return (
        cells.join(members.select(MEMBER).distinct(), MEMBER, "left_semi")
        .select(MEMBER, F.explode(runs).alias("run")).distinct()
    )


def rejected_codes(found: DataFrame, codes: DataFrame) -> DataFrame:
    """KEYS, code: the codes of the member's allergy section beside the quoted one, as rows."""
    one = found.where((F.col("intent") == ALLERGY) & F.col("refusal").isNull()).select(
        *KEYS, X.code_runs(F.col("code")).alias("own")
    )
    return one.join(codes, MEMBER).where(~F.array_contains("own", F.col("run"))).select(*KEYS, F.col("run").alias("code"))


def guard_failures(found: DataFrame, cells: DataFrame, codes: DataFrame) -> DataFrame:
    """Keys of allergy answers where another code stands without a negation before it.

    The lines about rejected codes negate themselves. Only answers where another code of the
    section stands in a digit run, or whose quoted code could hold a shorter one, are looked at place by place.
    """
    allergy = found.where((F.col("intent") == ALLERGY) & F.col("refusal").isNull())
    lines = (
        allergy.select(*KEYS, F.lit(LEAD).alias("rank"), *[F.lit("").alias(name) for name in DOCUMENT[::2]], F.col("lead").alias("text"), "code")
        .unionByName(
            cells.where(F.col("intent") == ALLERGY).join(allergy.select(*KEYS, "code"), KEYS)
            .select(*KEYS, F.lit(CELL).alias("rank"), *DOCUMENT[::2], F.col("unit").alias("text"), "code")
        )
    )
    runs = F.filter(F.regexp_extract_all("text", F.lit(r"[0-9]{6,}"), F.lit(0)), lambda run: run != F.col("code"))
    other = code_pieces(lines.select(*KEYS, F.explode(F.array_distinct(runs)).alias("_run")), "_run")
    shared = other.join(codes.withColumnRenamed("run", "code"), [MEMBER, "code"], "left_semi").select(*KEYS)
    shortest = codes.groupBy(MEMBER).agg(F.min(F.length("run")).alias("shortest"))
    holding = allergy.join(shortest, MEMBER).where(F.length("code") > F.col("shortest")).select(*KEYS)
    doubtful = written(shared.union(holding).distinct(), "doubtful")
    rejected = rejected_codes(found.join(doubtful, KEYS, "left_semi"), codes)
    looked = lines.join(doubtful, KEYS, "left_semi")
    return unguarded(looked, rejected, KEYS, ["rank", "element_id", "document_id"]).where("unguarded > 0").select(*KEYS)


def heads(found: DataFrame, cells: DataFrame, failures: DataFrame) -> DataFrame:
    """`singles` with the number of cells and the last word on the refusal, by flags of the lines."""
    by_key = cells.groupBy(*KEYS).agg(F.count("*").alias("cells"), F.bool_or("bad").alias("bad_cell"))
    joined = found.join(by_key, KEYS, "left").join(failures.withColumn("failed", F.lit(True)), KEYS, "left")
    bad = F.coalesce("bad_cell", F.lit(False)) | X.has_banned_claim(F.col("lead")) | (F.size(problems(own_citation())) > 0)
    refused = F.coalesce(
        "refusal", F.when(F.col("failed"), fv.REFUSAL_TEXT["allergy_guard"]), F.when(bad, fv.REFUSAL_TEXT["citation_check"])
    )
    return joined.withColumn("refusal", refused).withColumn(
        "cells", F.when(F.col("refusal").isNull(), F.coalesce("cells", F.lit(0))).otherwise(0).cast("long")
    ).drop("bad_cell", "failed")


def note() -> Column:
    """What is said where no cell matched."""
    none = F.when(F.col("intent") == MEDICATION, fv.NO_MEDICATION_CELL).otherwise(fv.NO_ALLERGY_CELL)
    return F.when(F.col("cells") == 0, none)


def rejected_line(quoted: Column, other: Column) -> Column:
    return filled(fv.REJECTED_LINE, other=other, code=quoted)


class SingleAnswers:
    """The parts of the answers to asked keys: `heads`, `cells` and `rejected`, as tables.

    `intents` are the classes that can be asked: tables and sections of the others are not read.
    """

    def __init__(self, core: Core, asked: DataFrame, intents: tuple[str, ...] = INTENTS) -> None:
        keys = written(asked_keys(asked).where(F.col("intent").isin(*intents)), "asked")
        found = written(singles(core, keys, intents), "singles")
        cells = written(cell_lines(core, found, intents), "cells")
        if ALLERGY in intents:
            allergies = found.where((F.col("intent") == ALLERGY) & F.col("refusal").isNull())
            self.codes = written(section_codes(core, allergies), "codes")
            failures = guard_failures(found, cells, self.codes)
        else:
            self.codes = core["patient"].sparkSession.createDataFrame([], f"{MEMBER} string, run string")
            failures = found.select(*KEYS).limit(0)
        self.heads = written(heads(found, cells, failures), "heads")
        self.cells = cells.join(self.heads.where("refusal IS NULL").select(*KEYS), KEYS, "left_semi")
        self.rejected = rejected_codes(self.heads, self.codes)

    def lines(self) -> DataFrame:
        """KEYS, rank, first, second, text, citation: every line of the cited answers, in the order of the middle three."""
        none = F.lit(None)
        cited = self.heads.where("refusal IS NULL")

        def line(rows: DataFrame, rank: int, text: Column, cite: Column | None = None, *order: str) -> DataFrame:
            names = [F.col(name) for name in order] + [F.lit("")] * (2 - len(order))
            given = none.cast(self.cells.schema["citation"].dataType) if cite is None else cite
            return rows.select(
                *KEYS, F.lit(rank).alias("rank"), names[0].alias("first"), names[1].alias("second"),
                text.alias("text"), given.alias("citation"),
            )

        rejected = self.rejected.withColumnRenamed("code", "other").join(cited.select(*KEYS, "code"), KEYS)
        parts = [
            line(cited, LEAD, F.col("lead"), own_citation()),
            line(self.cells, CELL, F.col("unit"), F.col("citation"), "element_id", "document_id"),
            line(rejected, REJECTED, rejected_line(F.col("code"), F.col("other")), None, "other"),
            line(cited.where(note().isNotNull()), NOTE, note()),
            line(cited, FOOTER, F.lit(fv.RECORD_FOOTER)),
        ]
        return reduce(DataFrame.unionByName, parts)

    def verdicts(self) -> DataFrame:
        """KEYS, status, refusal, quoted_code, cells, citations of every asked key that has rows."""
        cited = F.col("refusal").isNull()
        return self.heads.select(
            *KEYS, F.when(cited, "cited").otherwise("refused").alias("status"), "refusal",
            F.when(cited, F.col("code")).alias("quoted_code"), "cells",
            F.when(cited, F.col("cells") + 1).otherwise(0).cast("long").alias("citations"),
        )
