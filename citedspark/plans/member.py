"""Member aggregates and panels, for all members at once or for one."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citedspark.fixed_values import ANTIHISTAMINE_WORDS
from citedspark.functions.columns import day_matches, down, up
from citedspark.operators.ranking import top_rows
from citedspark.plans.conform import Core

MEMBER = "patient_id"
PROFILE = ("first_name", "last_name", "birthdate", "deathdate", "gender", "city", "state")


def dealt(core: Core, df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by keys to as many tasks as the views ask for, if they say it (`core.tasks`).

    Without it a join or window takes the session's number, and a task's share grows with the tables.
    """
    tasks = getattr(core, "tasks", None)
    return df if tasks is None else df.repartition(tasks, *keys)


def for_member(df: DataFrame, member: str | None) -> DataFrame:
    """Optional restriction to one member, which reaches the scan."""
    return df if member is None else df.filter(F.col(MEMBER) == F.lit(member))


def member_summary(core: Core) -> DataFrame:
    """One row per member with the sizes of its eight child tables and its last encounter.

    The children are stacked and counted in one grouping, so there is one shuffle and one
    join instead of eight of each; counts are combined before the shuffle.
    """
    none = F.lit(None)

    def rows(view: str, kind: str, ts: Column = none, filled: Column = none) -> DataFrame:
        return core[view].select(
            MEMBER, F.lit(kind).alias("kind"), ts.cast("timestamp_ntz").alias("ts"), filled.isNotNull().alias("filled")
        )

    documents = core["document_section"].select(MEMBER, "document_id").filter(
        F.col("document_id").isNotNull()
    ).distinct()
    children = [
        rows("encounter", "encounter", F.col("start_ts")),
        *[rows(view, view) for view in ("claim", "medication", "condition", "observation", "allergy")],
        rows("payer_transition", "coverage", filled=F.col("member_id")),
        documents.select(
            MEMBER, F.lit("document").alias("kind"), none.cast("timestamp_ntz").alias("ts"), F.lit(False).alias("filled")
        ),
    ]

    def counted(kind: str) -> Column:
        return F.count_if(F.col("kind") == kind)

    counts = (
        reduce(DataFrame.unionByName, children)
        .groupBy(MEMBER)
        .agg(
            counted("encounter").alias("encounter_count"),
            F.max(F.when(F.col("kind") == "encounter", F.col("ts"))).alias("last_encounter_ts"),
            counted("claim").alias("claim_count"),
            counted("medication").alias("medication_count"),
            counted("condition").alias("condition_count"),
            counted("observation").alias("observation_count"),
            counted("allergy").alias("allergy_count"),
            counted("coverage").alias("coverage_span_count"),
            F.count_if((F.col("kind") == "coverage") & F.col("filled")).alias(
                "coverage_span_with_member_id_count"
            ),
            counted("document").alias("document_count"),
        )
    )
    return (
        core["patient"]
        .select(MEMBER, *PROFILE)
        .join(counts, MEMBER, "left")
        .select(
            MEMBER,
            *PROFILE,
            *[
                F.col(name) if name == "last_encounter_ts" else F.coalesce(name, F.lit(0)).alias(name)
                for name in counts.columns
                if name != MEMBER
            ],
        )
    )


def member_coverage(core: Core) -> DataFrame:
    """Coverage spans with the payer's name; a span of an unknown payer is left out."""
    return (
        core["payer_transition"]
        .join(core["payer"].select("payer_id", "payer_name"), "payer_id")
        .select(
            MEMBER, "member_id", "start_ts", "end_ts", "payer_id", "payer_name",
            "secondary_payer_id", "plan_ownership", "owner_name",
        )
    )


def _claims_on_encounters(core: Core, claim: list[str], encounter: list[str]) -> DataFrame:
    e = core["encounter"].select(MEMBER, "encounter_id", *encounter)
    c = dealt(core, core["claim"].select(MEMBER, "appointment_id", *claim), "appointment_id", MEMBER)
    return c.join(e, (c["appointment_id"] == e["encounter_id"]) & (c[MEMBER] == e[MEMBER])).drop(c[MEMBER])


def member_encounter_claim(core: Core) -> DataFrame:
    return _claims_on_encounters(
        core, ["claim_id", "diagnosis_1", "primary_payer_id"], ["encounter_class", "start_ts"]
    ).select(
        MEMBER, "encounter_id", "encounter_class", F.col("start_ts").alias("encounter_start_ts"),
        "claim_id", "appointment_id", "diagnosis_1", "primary_payer_id",
    )


def member_directory(core: Core) -> DataFrame:
    return core["patient"].select(MEMBER, *PROFILE).orderBy(up("last_name"), up("first_name"), up(MEMBER))


def members_named(core: Core, first: str, last: str) -> DataFrame:
    """Every member with exactly this name; more than one row means not resolved."""
    return core["patient"].filter((F.col("first_name") == first) & (F.col("last_name") == last)).select(
        MEMBER, *PROFILE
    )


def encounter_class_counts(core: Core, member: str | None = None) -> DataFrame:
    return for_member(core["encounter"], member).groupBy(MEMBER, "encounter_class").agg(
        F.count("*").alias("encounter_count")
    )


def is_laboratory(category: str = "category") -> Column:
    return F.lower(category) == "laboratory"


def child_counts(core: Core, member: str | None = None) -> DataFrame:
    """Laboratory, claim and claim-line counts per member, in one grouping."""

    def rows(df: DataFrame, kind: str) -> DataFrame:
        return for_member(df, member).select(MEMBER, F.lit(kind).alias("kind"))

    stacked = (
        rows(core["observation"].filter(is_laboratory()), "lab")
        .unionByName(rows(core["claim"], "claim"))
        .unionByName(rows(core["claim_line"], "line"))
    )
    return stacked.groupBy(MEMBER).agg(
        *[F.count_if(F.col("kind") == kind).alias(f"{kind}_count") for kind in ("lab", "claim", "line")]
    )


@dataclass(frozen=True)
class Panel:
    """Ordered rows of one view per member: columns (with aliases), order and how many."""

    view: str
    columns: tuple[str, ...]
    order: tuple[Column, ...] = ()
    limit: int | None = None
    where: Column | None = field(default=None, compare=False)


def _panels() -> dict[str, Panel]:
    spans = ("encounter_id", "code", "description")
    lab = is_laboratory()
    return {
        # chart panels
        "encounters": Panel(
            "encounter",
            ("encounter_id", "start_ts", "stop_ts", "encounter_class", "code", "description"),
            (down("start_ts"), up("encounter_id")),
            15,
        ),
        "conditions": Panel(
            "condition",
            ("start_date as start_ts", "stop_date as stop_ts", *spans),
            (up("start_date"), up("code"), up("encounter_id"), up("source_file_row_number")),
        ),
        "medications": Panel(
            "medication",
            ("start_ts", "stop_ts", *spans, "dispenses"),
            (up("start_ts"), up("code"), up("encounter_id"), up("source_file_row_number")),
        ),
        "labs": Panel(
            "observation",
            ("observation_ts as observed_at", *spans, "value_text as value", "units"),
            (down("observation_ts"), down("source_file_row_number")),
            25,
            lab,
        ),
        "coverage": Panel(
            "member_coverage",
            ("start_ts as start_date", "end_ts as end_date", "member_id", "payer_id", "payer_name"),
            (up("start_ts"), up("payer_id"), up("end_ts"), up("member_id")),
        ),
        # evidence for answers
        "recent_encounters": Panel(
            "encounter",
            ("encounter_id", "start_ts as start", "stop_ts", "encounter_class", "code", "description"),
            (down("start_ts"), up("encounter_id")),
            5,
        ),
        "condition_evidence": Panel(
            "condition",
            ("encounter_id", "start_date as start", "stop_date", "code", "description"),
            (
                F.when(F.col("stop_date").isNull(), 0).otherwise(1).asc(),
                down("start_date"),
                up("code"),
                up("encounter_id"),
                up("source_file_row_number"),
            ),
            10,
        ),
        "medication_evidence": Panel(
            "medication",
            ("encounter_id", "start_ts as start", "stop_ts", "code", "description", "dispenses"),
            (down("start_ts"), up("code"), up("encounter_id"), up("source_file_row_number")),
            10,
        ),
        "care_plan_evidence": Panel(
            "careplan",
            (
                "encounter_id", "start_date as start", "stop_date", "careplan_id", "code", "description",
                "reason_code", "reason_description",
            ),
            (down("start_date"), up("code"), up("careplan_id")),
            10,
        ),
        "lab_evidence": Panel(
            "observation",
            (
                "encounter_id", "source_file_row_number as row_id", "observation_ts as observed_at",
                "code", "description", "value_text as value", "units",
            ),
            (down("observation_ts"), down("source_file_row_number")),
            10,
            lab,
        ),
        "procedure_evidence": Panel(
            "procedure",
            (
                "encounter_id", "start_ts as start", "stop_ts", "code", "description",
                "reason_code", "reason_description",
            ),
            (down("start_ts"), up("code"), up("encounter_id"), up("source_file_row_number")),
            10,
        ),
        "immunization_evidence": Panel(
            "immunization",
            ("encounter_id", "immunization_ts as start", "code", "description"),
            (down("immunization_ts"), up("code"), up("encounter_id"), up("source_file_row_number")),
            10,
        ),
        "coverage_evidence": Panel(
            "member_coverage",
            ("start_ts as start", "end_ts as end", "member_id", "payer_id", "payer_name"),
            (down("start_ts"), up("payer_id"), up("end_ts"), up("member_id")),
            10,
        ),
    }


def panel(core: Core, name: str, member: str | None = None, members: DataFrame | None = None) -> DataFrame:
    """A panel for all members, one member, or the members of a table of ids.

    `position` counts a member's rows in the panel's order. Rows are sorted inside the placement by
    member; there is no sort across members.
    """
    wanted = _panels()[name]
    df = member_coverage(core) if wanted.view == "member_coverage" else core[wanted.view]
    df = for_member(df, member)
    if wanted.where is not None:
        df = df.filter(wanted.where)
    if members is not None:
        df = df.join(members.select(MEMBER), MEMBER, "left_semi")
    columns = [F.expr(f"`{c.split(' as ')[0]}`").alias(c.split(" as ")[-1]) for c in wanted.columns]
    if wanted.limit is None:
        if member is None:
            df = dealt(core, df, MEMBER)
        place = F.row_number().over(Window.partitionBy(MEMBER).orderBy(*wanted.order))
        return df.withColumn("position", place).select(MEMBER, *columns, "position")
    return top_rows(df, [MEMBER], wanted.order, wanted.limit).select(MEMBER, *columns, "position")


def first_claim_on_encounter(core: Core, member: str | None = None) -> DataFrame:
    joined = _claims_on_encounters(core, ["claim_id", "diagnosis_1", "service_ts"], [])
    first = top_rows(for_member(joined, member), [MEMBER], [up("service_ts"), up("claim_id")], 1)
    return first.select(
        MEMBER, "claim_id", "appointment_id", "encounter_id",
        F.col("diagnosis_1").alias("diagnosis1"), F.col("service_ts").alias("service_date"),
    )


def claim_evidence(core: Core, member: str | None = None, members: DataFrame | None = None) -> DataFrame:
    joined = for_member(
        _claims_on_encounters(
            core, ["claim_id", "diagnosis_1", "service_ts"], ["encounter_class", "description"]
        ),
        member,
    )
    if members is not None:
        joined = joined.join(members.select(MEMBER), MEMBER, "left_semi")
    return top_rows(joined, [MEMBER], [down("service_ts"), up("claim_id")], 5).select(
        MEMBER, "claim_id", "encounter_id", F.col("service_ts").alias("service_date"),
        F.col("diagnosis_1").alias("diagnosis1"), "encounter_class",
        F.col("description").alias("encounter_description"), "position",
    )


def antihistamine_rows(core: Core, member: str | None = None) -> DataFrame:
    text = F.upper("description")
    hit = reduce(lambda a, b: a | b, [text.contains(word) for word in ANTIHISTAMINE_WORDS])
    return for_member(core["medication"], member).filter(hit).select(
        MEMBER, "encounter_id", F.col("start_ts").alias("start"), "code", "description"
    )


def named_medications(core: Core, first: str | None = None, last: str | None = None, code: str | None = None) -> DataFrame:
    """Medications with the member's name: of all members, or by name and code, filtered before the join."""
    people, rows = core["patient"], core["medication"]
    for column, value in (("first_name", first), ("last_name", last)):
        people = people if value is None else people.filter(F.col(column) == F.lit(value))
    rows = rows if code is None else rows.filter(F.col("code") == F.lit(code))
    medication = rows.select(MEMBER, "encounter_id", "code", F.col("start_ts").alias("start"), "description")
    if first is None and last is None and code is None:
        medication = dealt(core, medication, MEMBER)
    return people.select(MEMBER, "first_name", "last_name").join(medication, MEMBER)


def allergy_rows(core: Core, member: str | None = None, day: str | None = None) -> DataFrame:
    df = for_member(core["allergy"], member)
    if day is not None:
        df = df.filter(day_matches(F.col("start_date"), F.lit(day)))
    return df.select(
        MEMBER, "encounter_id", F.col("start_date").alias("start"), "code", "description",
        F.col("reaction_1_code").alias("reaction1"), F.col("reaction_1_description").alias("description1"),
        F.col("reaction_1_severity").alias("severity1"),
    )


CELL_FIELDS = ("document_id", MEMBER, "section_loinc", "section_title", "element_id", "text", "code")


def section_cells(core: Core, section: str, member: str | None = None) -> DataFrame:
    """The cells of a section, with their position by element id inside the member's rows."""
    place = F.row_number().over(Window.partitionBy(MEMBER).orderBy(up("element_id"), up("document_id"), up("text")))
    return (
        for_member(core["document_section"], member)
        .filter(F.col("section_loinc") == section)
        .select(*CELL_FIELDS, place.alias("position"))
    )


def about_medication(cell_code: Column, cell_text: Column, code: Column, description: Column) -> Column:
    """The cell has the code, contains it, or its text contains the description."""
    return (
        (cell_code == code)
        | cell_code.contains(code)
        | F.upper(cell_text).contains(F.upper(description))
    )


def medication_cells(core: Core, member: str, code: str, description: str) -> DataFrame:
    return section_cells(core, "10160-0", member).filter(
        about_medication(F.col("code"), F.col("text"), F.lit(code), F.lit(description))
    )


def section_counts(core: Core, sections: tuple[str, ...], member: str | None = None) -> DataFrame:
    return (
        for_member(core["document_section"], member)
        .filter(F.col("section_loinc").isin(*sections))
        .groupBy(MEMBER, "section_loinc")
        .agg(F.count("*").alias("rows_with_evidence"))
    )


def section_documents(core: Core) -> DataFrame:
    return core["document_section"].groupBy("section_loinc").agg(
        F.count_distinct("document_id").alias("documents")
    )


def population(core: Core) -> DataFrame:
    """One row of sizes: members, encounters, claims on encounters, documents with a member."""
    size = F.count("*")
    documents = core["document_section"].select("document_id").distinct()
    matched = documents.join(
        core["patient"].select(F.col(MEMBER).alias("document_id")), "document_id", "left_semi"
    )
    on_encounters = _claims_on_encounters(core, [], [])
    return (
        core["patient"].agg(size.alias("member_count"))
        .crossJoin(core["encounter"].agg(size.alias("encounter_count")))
        .crossJoin(on_encounters.agg(size.alias("claims_on_encounter")))
        .crossJoin(matched.agg(size.alias("documents_matched")))
    )


def chart(core: Core, member: str | None = None) -> DataFrame:
    """The ten panels of all members, or of one, as rows: patient_id, panel, position, moment, code, label.

    `moment` is the row's time, `code` its key and `label` its words or its count. A panel without rows
    for a member has none here.
    """

    def rows(df: DataFrame, name: str, at: str | None, code: str | None, label: Column, position: Column | str = "position") -> DataFrame:
        nothing = F.lit(None).cast("string")
        return df.select(
            MEMBER, F.lit(name).alias("panel"), (F.col(position) if isinstance(position, str) else position).cast("int").alias("position"),
            (F.col(at).cast("string") if at else nothing).alias("moment"), (F.col(code) if code else nothing).alias("code"),
            label.cast("string").alias("label"),
        )

    first = F.lit(1)
    by_count = Window.partitionBy(MEMBER).orderBy(F.desc("encounter_count"), "encounter_class")
    classes = encounter_class_counts(core, member).withColumn("position", F.row_number().over(by_count))
    counts = child_counts(core, member).select(
        MEMBER, F.inline(F.array(*[F.struct(F.lit(f"{kind}_count").alias("panel"), F.col(f"{kind}_count").alias("n")) for kind in ("lab", "claim", "line")]))
    ).where("n > 0")
    description = F.col("description")
    parts = [
        rows(classes, "encounter_counts", None, "encounter_class", F.col("encounter_count")),
        rows(panel(core, "encounters", member), "encounters", "start_ts", "encounter_id", description),
        rows(panel(core, "conditions", member), "conditions", "start_ts", "code", description),
        rows(panel(core, "medications", member), "medications", "start_ts", "code", description),
        rows(panel(core, "labs", member), "labs", "observed_at", "code", F.col("value")),
        counts.select(
            MEMBER, "panel", first.alias("position"), F.lit(None).cast("string").alias("moment"),
            F.lit(None).cast("string").alias("code"), F.col("n").cast("string").alias("label"),
        ),
        rows(first_claim_on_encounter(core, member), "claim_on_encounter", "service_date", "claim_id", F.col("diagnosis1"), first),
        rows(panel(core, "coverage", member), "coverage", "start_date", "payer_id", F.col("payer_name")),
    ]
    return reduce(DataFrame.unionByName, parts)


#: Folders that member tables are dealt to, so that one member's rows lie in one of them.
MEMBER_FOLDERS = 64


def write_by_member(rows: DataFrame, path: str, folders: int = MEMBER_FOLDERS, tasks: int | None = None) -> None:
    """Rows with a patient_id as Parquet in `folders` folders by member, sorted by member inside a file.

    With `tasks`, a folder is dealt to its share of that many tasks, each of which writes one file of few folders.
    """
    folder = F.pmod(F.xxhash64(MEMBER), F.lit(folders)).cast("int")
    placed = rows.withColumn("folder", folder)
    if tasks is None:
        placed = placed.repartition("folder", MEMBER)
    else:
        slices = -(-tasks // folders)
        placed = placed.repartition(folders * slices, "folder", F.pmod(F.hash(MEMBER), F.lit(slices)))
    placed.sortWithinPartitions("folder", MEMBER).write.partitionBy("folder").option("compression", "zstd").parquet(path)


def read_member(spark: SparkSession, path: str, member: str, folders: int = MEMBER_FOLDERS) -> DataFrame:
    """One member's rows of what `write_by_member` wrote: one folder is listed, and the filter reaches its files."""
    return spark.sql(
        "SELECT * EXCEPT (folder) FROM {rows} WHERE folder = pmod(xxhash64(:member), :folders) AND patient_id = :member",
        args={"member": member, "folders": folders},
        rows=spark.read.parquet(path),
    )
