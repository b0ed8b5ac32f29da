"""The given star-schema tables in the conformed shape, with no claim that they are clinical.

Customers act as members, orders as encounters, order lines as coded spans, events as
observations, nations as payers. Every view reads its whole source table.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from citedspark.plans.cohort import CohortSpec

# Thresholds for these tables: order dates run from 1995 to 2001.
SPEC = CohortSpec(
    index="1999-01-01",
    horizon="2000-01-01",
    acute_classes=("1-URGENT",),
    age_min=3,
    active_min=3,
    value_code="total",
    value_min="250000",
)


def text(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


def coded(base: int, column: str) -> Column:
    """A digit code that does not collide with the codes of another base."""
    return (F.lit(base) + F.col(column)).cast("string")


def joined(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else text(p) for p in parts])


VIEWS = (
    "patient encounter condition medication observation procedure allergy careplan immunization "
    "device imaging_study supply payer payer_transition claim claim_line document_section"
).split()


class Core(Mapping):
    """The conformed views, each built when it is asked for."""

    def __init__(self, source: Source):
        self.source = source

    @property
    def tasks(self) -> int:
        return self.source.tasks()

    def __getitem__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise KeyError(name)
        return getattr(self.source, name)()

    def __iter__(self) -> Iterator[str]:
        return iter(VIEWS)

    def __len__(self) -> int:
        return len(VIEWS)


class Source:
    """The given tables of one folder and the conformed views over them."""

    _schemas: dict[str, StructType] = {}
    _splits: dict[str, int] = {}

    #: Tasks for each split that the largest table is read in.
    TASKS_A_SPLIT = 8

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        path = f"{self.folder}/{name}.parquet"
        if path not in self._schemas:
            self._schemas[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(self._schemas[path]).parquet(path)

    def tasks(self) -> int:
        """How many tasks order lines are dealt to: in proportion to the table, so that a task's share does not grow."""
        path = f"{self.folder}/lineitem.parquet"
        if path not in self._splits:
            self._splits[path] = self.table("lineitem").rdd.getNumPartitions()
        return max(
            self._splits[path] * self.TASKS_A_SPLIT,
            int(self.spark.conf.get("spark.sql.shuffle.partitions")),
            self.spark.sparkContext.defaultParallelism,
        )

    def lines_by_order(self) -> DataFrame:
        """Order lines dealt out by order, so that joins and groups by order need no further shuffle."""
        return self.table("lineitem").repartition(self.tasks(), "l_orderkey")

    def order_lines(self) -> DataFrame:
        """Order lines with the member and date of their order, dealt out by order."""
        orders = self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        return self.lines_by_order().join(orders, F.col("l_orderkey") == F.col("o_orderkey"))

    def core(self) -> Core:
        return Core(self)

    def patient(self) -> DataFrame:
        dates = self.table("orders").groupBy("o_custkey").agg(
            F.min("o_orderdate").alias("first_order"), F.max("o_orderdate").alias("last_order")
        )
        nation = self.table("nation").join(
            self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left"
        )
        return (
            self.table("customer")
            .join(dates, F.col("c_custkey") == F.col("o_custkey"), "left")
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .select(
                text("c_custkey").alias("patient_id"),
                F.to_date("first_order").alias("birthdate"),
                F.when(F.col("c_acctbal") < 0, F.to_date("last_order")).alias("deathdate"),
                joined("Customer", F.col("c_custkey")).alias("first_name"),
                joined("Nation", F.col("c_nationkey")).alias("last_name"),
                F.col("c_mktsegment").alias("gender"),
                F.col("n_name").alias("city"),
                F.col("r_name").alias("state"),
                F.col("c_custkey").alias("source_file_row_number"),
            )
        )

    def encounter(self) -> DataFrame:
        return self.table("orders").select(
            text("o_orderkey").alias("encounter_id"),
            F.col("o_orderdate").alias("start_ts"),
            (F.col("o_orderdate") + F.expr("interval 1 day")).alias("stop_ts"),
            text("o_custkey").alias("patient_id"),
            F.col("o_orderpriority").alias("encounter_class"),
            coded(100000000, "o_orderkey").alias("code"),
            joined("Order ", F.col("o_orderstatus")).alias("description"),
            F.col("o_totalprice").cast("decimal(18,2)").alias("total_claim_cost"),
            F.col("o_orderkey").alias("source_file_row_number"),
        )

    def _line_number(self) -> Column:
        return ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey") * 31 + F.col("l_suppkey")).alias(
            "source_file_row_number"
        )

    def condition(self) -> DataFrame:
        return self.order_lines().select(
            F.to_date("o_orderdate").alias("start_date"),
            F.when(F.col("l_linestatus") == "F", F.to_date("l_shipdate")).alias("stop_date"),
            text("o_custkey").alias("patient_id"),
            text("l_orderkey").alias("encounter_id"),
            coded(100000, "l_partkey").alias("code"),
            joined("Part ", F.col("l_partkey"), " ", F.col("l_returnflag")).alias("description"),
            self._line_number(),
        )

    def medication(self) -> DataFrame:
        special = (F.col("l_linenumber") == 7) & (F.col("l_returnflag") == "R")
        return self.order_lines().select(
            F.col("o_orderdate").alias("start_ts"),
            F.col("l_shipdate").alias("stop_ts"),
            text("o_custkey").alias("patient_id"),
            text("l_orderkey").alias("encounter_id"),
            coded(100000, "l_partkey").alias("code"),
            joined("Part ", F.col("l_partkey"), F.when(special, " Fexofenadine").otherwise("")).alias("description"),
            F.col("l_quantity").cast("bigint").alias("dispenses"),
            F.col("l_extendedprice").cast("decimal(18,2)").alias("total_cost"),
            self._line_number(),
        )

    def procedure(self) -> DataFrame:
        return self.order_lines().select(
            F.col("l_shipdate").alias("start_ts"),
            F.col("l_shipdate").alias("stop_ts"),
            text("o_custkey").alias("patient_id"),
            text("l_orderkey").alias("encounter_id"),
            coded(500000, "l_suppkey").alias("code"),
            joined("Supplier ", F.col("l_suppkey")).alias("description"),
            F.col("l_returnflag").alias("reason_code"),
            F.col("l_linestatus").alias("reason_description"),
            self._line_number(),
        )

    def observation(self) -> DataFrame:
        kind = F.col("event_type")
        measured = self.table("events").select(
            F.col("ts").alias("observation_ts"),
            text("user_id").alias("patient_id"),
            F.lit(None).cast("string").alias("encounter_id"),
            F.when(kind != "error", "Laboratory").alias("category"),
            kind.alias("code"),
            joined(kind, " event").alias("description"),
            F.when(kind == "view", F.col("props")).otherwise(text("value")).alias("value_text"),
            F.when(kind != "view", "points").alias("units"),
            F.col("event_id").alias("source_file_row_number"),
        )
        totals = self.table("orders").select(
            F.col("o_orderdate").alias("observation_ts"),
            text("o_custkey").alias("patient_id"),
            text("o_orderkey").alias("encounter_id"),
            F.lit("laboratory").alias("category"),
            F.lit("total").alias("code"),
            F.lit("Order total").alias("description"),
            F.when(F.col("o_orderstatus") == "P", "pending").otherwise(text("o_totalprice")).alias("value_text"),
            F.lit("currency").alias("units"),
            (F.col("o_orderkey") + 1000000000000).alias("source_file_row_number"),
        )
        return measured.unionByName(totals)

    def allergy(self) -> DataFrame:
        nothing = F.lit(None).cast("string")
        return self.table("orders").select(
            F.to_date("o_orderdate").alias("start_date"),
            text("o_custkey").alias("patient_id"),
            text("o_orderkey").alias("encounter_id"),
            coded(300000000, "o_orderkey").alias("code"),
            joined("Priority ", F.col("o_orderpriority")).alias("description"),
            nothing.alias("reaction_1_code"),
            nothing.alias("reaction_1_description"),
            nothing.alias("reaction_1_severity"),
            F.col("o_orderkey").alias("source_file_row_number"),
        )

    def careplan(self) -> DataFrame:
        day = F.to_date("o_orderdate")
        return self.table("orders").select(
            joined("CP", F.col("o_orderkey")).alias("careplan_id"),
            day.alias("start_date"),
            F.when(F.col("o_orderstatus") == "F", F.date_add(day, 30)).alias("stop_date"),
            text("o_custkey").alias("patient_id"),
            text("o_orderkey").alias("encounter_id"),
            coded(400000000, "o_orderkey").alias("code"),
            joined("Plan ", F.col("o_orderpriority")).alias("description"),
            F.col("o_orderstatus").alias("reason_code"),
            F.lit(None).cast("string").alias("reason_description"),
            F.col("o_orderkey").alias("source_file_row_number"),
        )

    def immunization(self) -> DataFrame:
        return self.table("events").select(
            F.col("ts").alias("immunization_ts"),
            text("user_id").alias("patient_id"),
            F.when(F.col("event_type") != "error", joined("E", F.col("event_id"))).alias("encounter_id"),
            coded(600000000, "event_id").alias("code"),
            joined("Dose ", F.col("event_type")).alias("description"),
            F.col("event_id").alias("source_file_row_number"),
        )

    def device(self) -> DataFrame:
        return self.order_lines().select(
            F.col("l_shipdate").alias("start_ts"),
            text("o_custkey").alias("patient_id"),
            text("l_orderkey").alias("encounter_id"),
            coded(500000, "l_suppkey").alias("code"),
            joined("Device ", F.col("l_suppkey")).alias("description"),
            self._line_number(),
        )

    def imaging_study(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderdate").alias("imaging_ts"),
            text("o_custkey").alias("patient_id"),
            text("o_orderkey").alias("encounter_id"),
            coded(700000000, "o_orderkey").alias("procedure_code"),
            F.col("o_orderpriority").alias("modality_description"),
            F.col("o_orderkey").alias("source_file_row_number"),
        )

    def supply(self) -> DataFrame:
        return self.order_lines().select(
            F.to_date("l_shipdate").alias("supply_date"),
            text("o_custkey").alias("patient_id"),
            text("l_orderkey").alias("encounter_id"),
            coded(100000, "l_partkey").alias("code"),
            joined("Supply ", F.col("l_partkey")).alias("description"),
            F.col("l_quantity").cast("bigint").alias("quantity"),
            self._line_number(),
        )

    def payer(self) -> DataFrame:
        return self.table("nation").select(
            joined("N", F.col("n_nationkey")).alias("payer_id"), F.col("n_name").alias("payer_name")
        )

    def payer_transition(self) -> DataFrame:
        customer = self.table("customer").select("c_custkey", "c_nationkey")
        return self.table("orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
            text("o_custkey").alias("patient_id"),
            F.when(F.col("o_orderstatus") != "P", joined("S", F.col("o_orderkey"))).alias("member_id"),
            F.col("o_orderdate").alias("start_ts"),
            (F.col("o_orderdate") + F.expr("interval 365 day")).alias("end_ts"),
            joined("N", F.col("c_nationkey")).alias("payer_id"),
            F.lit(None).cast("string").alias("secondary_payer_id"),
            F.col("o_orderpriority").alias("plan_ownership"),
            F.lit(None).cast("string").alias("owner_name"),
            F.col("o_orderkey").alias("source_file_row_number"),
        )

    def claim(self) -> DataFrame:
        lines = self.lines_by_order().groupBy("l_orderkey", "l_suppkey").agg(
            F.min("l_shipdate").alias("service_ts"), F.min("l_partkey").alias("part")
        )
        orders = self.table("orders").select("o_orderkey", "o_custkey")
        return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
            joined(F.col("l_orderkey"), "-", F.col("l_suppkey")).alias("claim_id"),
            text("o_custkey").alias("patient_id"),
            text("l_orderkey").alias("appointment_id"),
            "service_ts",
            coded(100000, "part").alias("diagnosis_1"),
            F.lit(None).cast("string").alias("primary_payer_id"),
        )

    def claim_line(self) -> DataFrame:
        return self.order_lines().select(
            joined(F.col("l_orderkey"), "-", F.col("l_linenumber"), "-", F.col("l_partkey")).alias("claim_line_id"),
            joined(F.col("l_orderkey"), "-", F.col("l_suppkey")).alias("claim_id"),
            text("o_custkey").alias("patient_id"),
            text("l_orderkey").alias("appointment_id"),
            F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"),
            coded(100000, "l_partkey").alias("procedure_code"),
            F.col("l_returnflag").alias("notes"),
        )

    def document_section(self) -> DataFrame:
        """Cells of one document per member: two per coded line, three per order and allergy, two per plan.

        The section is a column before the cells are exploded, so a section filter reaches the scans.
        """

        def cell(element: Column, words: Column, code: Column) -> Column:
            return F.struct(element.alias("element_id"), words.alias("text"), code.alias("code"))

        def cells(df: DataFrame, section: Column, title: Column, *each: Column) -> DataFrame:
            return df.select(
                text("o_custkey").alias("document_id"),
                text("o_custkey").alias("patient_id"),
                section.alias("section_loinc"),
                title.alias("section_title"),
                F.inline(F.array(*each)),
            )

        flag = F.col("l_returnflag")

        def by_flag(r: str | Column, a: str | Column, n: str | Column) -> Column:
            r, a, n = (F.lit(v) if isinstance(v, str) else v for v in (r, a, n))
            return F.when(flag == "R", r).when(flag == "A", a).otherwise(n)

        prefix = by_flag("conditions", "medications", "procedures")
        part, supplier = coded(100000, "l_partkey"), coded(500000, "l_suppkey")
        code = by_flag(part, part, supplier)
        label = by_flag(
            joined("Part ", F.col("l_partkey"), " ", flag),
            joined("Part ", F.col("l_partkey")),
            joined("Supplier ", F.col("l_suppkey")),
        )
        place = joined(
            F.col("l_orderkey"), F.lpad(text("l_linenumber"), 2, "0"), F.lpad(text("l_partkey"), 12, "0"),
            F.lpad(text("l_suppkey"), 10, "0"),
        )
        distinct_lines = self.order_lines().select(
            "o_custkey", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"
        ).distinct()
        lines = cells(
            distinct_lines,
            by_flag("11450-4", "10160-0", "47519-4"),
            by_flag("Problems", "Medications", "Surgeries"),
            cell(F.concat_ws("-", prefix, F.lit("desc"), place), label, code),
            cell(
                F.concat_ws("-", prefix, F.lit("code"), place),
                joined("http://www.nlm.nih.gov/research/umls/rxnorm ", code), code,
            ),
        )
        key, orders = F.col("o_orderkey"), self.table("orders")
        allergy, plan = coded(300000000, "o_orderkey"), coded(400000000, "o_orderkey")
        allergies = cells(
            orders, F.lit("48765-2"), F.lit("Allergies"),
            cell(joined("allergies-desc-", key), joined("Priority ", F.col("o_orderpriority")), allergy),
            cell(joined("allergies-code-", key), joined("http://snomed.info/sct ", allergy), allergy),
            cell(
                joined("entry-assertion-", key), F.lit("Allergy to substance"), coded(800000000, "o_orderkey")
            ),
        )
        plans = cells(
            orders, F.lit("18776-5"), F.lit("Care Plans"),
            cell(joined("careplans-desc-", key), joined("Plan ", F.col("o_orderpriority")), plan),
            cell(joined("careplans-code-", key), joined("http://snomed.info/sct ", plan), plan),
        )
        return lines.unionByName(allergies).unionByName(plans)
