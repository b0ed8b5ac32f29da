import uuid
from datetime import datetime, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from citedspark.functions import columns as C
from citedspark.operators import gates as G
from citedspark.operators import metrics as S
from citedspark.plans import cohort as K
from citedspark.plans import conform
from citedspark.schemas import TABLES
from citedspark.sources import facts as FA
from citedspark.sources import files as FS
from citedspark.sources import flat_files as L

NOW = datetime(2024, 1, 2, 3, 4, 5, tzinfo=timezone.utc)
PATIENTS = (
    "Id,BIRTHDATE,DEATHDATE,SSN,DRIVERS,PASSPORT,PREFIX,FIRST,MIDDLE,LAST,SUFFIX,MAIDEN,MARITAL,RACE,ETHNICITY,GENDER,"
    "BIRTHPLACE,ADDRESS,CITY,STATE,COUNTY,FIPS,ZIP,LAT,LON,HEALTHCARE_EXPENSES,HEALTHCARE_COVERAGE,INCOME\n"
    'p1,1950-02-28,,999,D,P,,"Ann ""A"", B",,Bell2,,,,r,e,F,b,"1 Road",Town,State,C,,01234,42.123456789012345,-71.5,1.50,2,100\n'
    "p2,2023-06-01,2023-07-01,998,,,,Cy3,,Dee4,,,,r,e,M,b,x,Town,State,C,,00001,1,2,0,0,0\n"
)


def write(folder, name, text):
    path = folder / f"{name}.csv"
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_typed_load_and_minimised_view(spark, tmp_path):
    raw = L.load_table(spark, write(tmp_path, "patients", PATIENTS), "patients", "batch", NOW)
    kinds = dict(raw.dtypes)
    assert kinds["birthdate"] == "date" and kinds["lat"] == "decimal(20,15)" and kinds["income"] == "bigint"
    rows = raw.orderBy("source_file_row_number").collect()
    assert [r["source_file_row_number"] for r in rows] == [1, 2]
    assert rows[0]["first"] == 'Ann "A", B' and rows[0]["zip"] == "01234" and rows[0]["deathdate"] is None
    assert rows[0]["lat"] == Decimal("42.123456789012345") and rows[0]["source_filename"] == "patients.csv"
    assert rows[0]["loaded_at"] == NOW.replace(tzinfo=None) and rows[0]["load_batch_id"] == "batch"
    view = conform.conformed(raw, "patients")
    assert set(view.columns) == {
        "patient_id", "birthdate", "deathdate", "first_name", "last_name", "gender", "city", "state",
        "source_filename", "source_file_row_number", "loaded_at", "load_batch_id",
    }
    gates = G.restricted_gates(spark, {"patient": view}, raw)
    assert {r["status"] for r in gates.collect()} == {"PASS"}
    leaky = G.restricted_gates(spark, {"patient": view.withColumn("SSN", F.lit(1)).withColumn("zip", F.lit(1))})
    assert [r["actual_value"] for r in leaky.collect()] == [1, 1]


def test_timestamps_keep_their_digits_in_any_zone(spark, tmp_path):
    text = "START,STOP,PATIENT,ENCOUNTER,CODE,DESCRIPTION,UDI\n2005-06-18T13:48:14Z,,p,e,c,d,u\n"
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        row = L.load_table(spark, write(tmp_path, "devices", text), "devices", "b", NOW).first()
        assert row["start"] == datetime(2005, 6, 18, 13, 48, 14) and row["stop"] is None
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("bad", ["2005-06-18,p,e,c,d\n", "06/18/2005,p,e,c,d,1\n", "2005-06-18,p,e,c,d,many\n"])
def test_bad_rows_stop_the_load_and_keep_the_old_table(spark, tmp_path, bad):
    head = "DATE,PATIENT,ENCOUNTER,CODE,DESCRIPTION,QUANTITY\n"
    database = f"load_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database}")
    target = f"{database}.supplies"
    good = write(tmp_path, "good", head + "2005-06-18,p,e,c,d,1\n")
    for _ in range(2):
        L.refresh(L.load_table(spark, good, "supplies", "b", NOW), target)
    with pytest.raises(Exception):
        L.refresh(L.load_table(spark, write(tmp_path, "bad", head + bad), "supplies", "b", NOW), target)
    assert spark.table(target).count() == 1
    more = L.load_table(spark, write(tmp_path, "more", head + "2005-06-18,p,e,c,d,1\n2005-06-19,,e,c,d,2\n"), "supplies", "b", NOW)
    with pytest.raises(ValueError, match="missing_patient 1"):
        L.refresh(more, target, L.required_filled("supplies"))
    assert spark.table(target).count() == 1
    moved = more.select(*reversed(more.columns))  # columns go by name
    assert L.refresh(moved, target, {"no_day": F.col("date").isNull()}) == {"row_count": 2, "no_day": 0}
    assert {r["quantity"] for r in spark.table(target).collect()} == {1, 2}
    assert {r["tableName"] for r in spark.sql(f"SHOW TABLES IN {database}").collect()} == {"supplies"}


def test_sources_that_lack_files_columns_or_ids(spark, tmp_path):
    write(tmp_path, "medications", "START,PATIENT,ENCOUNTER,CODE\n2005-06-18,p,e, c \n")
    write(tmp_path, "procedures", "START,PATIENT,ENCOUNTER\n2005-06-18,p,e\n")
    (tmp_path / "encounters.csv").mkdir()
    write(tmp_path / "encounters.csv", "part-0", "Id,START,PATIENT,CODE\ne,2005-06-18,p,c\n")
    write(tmp_path, "nobody", "Id,X\n ,1\n")
    write(tmp_path, "unnamed", "Key\np\n")
    write(tmp_path, "patients", "Id\np\np\n q\n")
    cells = spark.createDataFrame([("medications",), ("allergies",), ("",)], "csv_table string")
    facts, failures = FA.available_facts(spark, str(tmp_path), cells)
    assert {(r["csv_table"], r["code"]) for r in facts.collect()} == {("medications", "c"), ("encounters", "c")}
    assert {r["problem"] for r in failures.collect()} == {
        "missing reconciliation file allergies.csv for allergies", "procedures.csv missing columns CODE",
    }
    _, every = FA.available_facts(spark, str(tmp_path))
    assert every.count() == 5 and FA.available_facts(spark, str(tmp_path / "gone"))[1].count() == 7
    assert FA.available_facts(spark, str(tmp_path / "gone"))[0].count() == 0
    want = {
        "patients": ({"p", "q"}, []), "nobody": (set(), ["nobody.csv has no patient ids"]),
        "unnamed": (set(), ["unnamed.csv has no Id column"]), "absent": (set(), ["cannot read absent.csv"]),
    }
    for name, (ids, problems) in want.items():
        members, failed = FA.available_members(spark, str(tmp_path), name)
        assert {r["patient_id"] for r in members.collect()} == ids and [r["problem"] for r in failed.collect()] == problems


def test_links_in_one_grouping(spark):
    child = spark.createDataFrame([("a", 1), ("b", None), ("c", 9), ("c", 9), (None, 2)], "p string, n long")
    parent = spark.createDataFrame([("a",), ("b",)], "id string")
    numbers = spark.createDataFrame([(1,), (2,)], "id long")
    links = {"text": (child, "p", "parent"), "number": (child, "n", "numbers"), "needed": (child, "n", "numbers")}
    row = G.link_orphans(spark, links, {"parent": (parent, "id"), "numbers": (numbers, "id")}, frozenset({"needed"})).first()
    assert row.asDict() == {"text": 2, "number": 2, "needed": 3}
    gates = G.report(G.gate_rows(G.link_orphans(spark, links, {"parent": (parent, "id"), "numbers": (numbers, "id")}), {"text": 2}))
    assert [(r["check_name"], r["status"], r["position"]) for r in gates.collect()] == [
        ("needed", "FAIL", 1), ("number", "FAIL", 2), ("text", "PASS", 3)
    ]


@pytest.mark.parametrize(
    "header", ["DATE,PATIENT,ENCOUNTER,CODE,DESCRIPTION", "DATE,PATIENT,ENCOUNTER,CODE,DESCRIPTION,QUANTITY,LOT",
               "PATIENT,DATE,ENCOUNTER,CODE,DESCRIPTION,QUANTITY"],
)
def test_a_header_that_differs_stops_the_load(spark, tmp_path, header):
    path = write(tmp_path, "supplies", header + "\n" + ",".join("1" for _ in header.split(",")) + "\n")
    with pytest.raises(ValueError, match="header"):
        L.load_table(spark, path, "supplies", "b", NOW)


def test_row_numbers_over_split_files(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for part in range(3):
        rows = "".join(f"2005-06-18,p{n},e,c,d,{n}\n" for n in range(1, 1501))
        write(folder, f"part{part}", "DATE,PATIENT,ENCOUNTER,CODE,DESCRIPTION,QUANTITY\n" + rows)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        df = L.load_table(spark, str(folder), "supplies", "b", NOW)
        assert df.rdd.getNumPartitions() > 0
        assert df.filter(F.col("source_file_row_number") != F.col("quantity")).count() == 0
        assert df.count() == 4500 and df.select("source_filename").distinct().count() == 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_load_by_name(spark, tmp_path):
    path = write(tmp_path, "supplies", "date,Patient,ENCOUNTER,CODE,DESCRIPTION,QUANTITY\n2005-06-18,p,e,c,d,4\n")
    df = L.load_table(spark, path, "supplies", "b", NOW, by_name=("quantity", "PATIENT"))
    assert df.select("quantity", "patient").first() == (4, "p")
    with pytest.raises(ValueError, match="lot"):
        L.load_table(spark, path, "supplies", "b", NOW, by_name=("lot",))


def test_conformed_names():
    claim = TABLES["claims"]
    assert claim.view_name("Id") == "claim_id" and claim.view_name("PATIENTID") == "patient_id"
    assert claim.view_name("STATUSP") == "status_patient" and claim.view_name("DIAGNOSIS3") == "diagnosis_3"
    assert claim.view_name("LASTBILLEDDATE1") == "last_billed_ts_1" and claim.column_type("LASTBILLEDDATE1") == "timestamp_ntz"
    line = TABLES["claims_transactions"]
    assert line.view_name("FEESCHEDULEID") == "fee_schedule_id" and line.column_type("UNITS") == "bigint"
    assert TABLES["observations"].column_type("UNITS") == "string"
    assert TABLES["conditions"].view_name("START") == "start_date" and TABLES["medications"].view_name("START") == "start_ts"
    assert TABLES["allergies"].view_name("SEVERITY2") == "reaction_2_severity"
    assert TABLES["providers"].column_type("ENCOUNTERS") == "bigint"
    assert TABLES["payers"].column_type("AMOUNT_COVERED") == "decimal(18,2)"
    assert TABLES["payers"].column_type("COVERED_ENCOUNTERS") == "bigint"


def test_manifest(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    manifest = FS.file_manifest(spark, str(tmp_path))
    row = manifest.first()
    assert row["bytes"] == 3 and row["sha256"].startswith("BA7816BF")
    pinned = spark.createDataFrame([("a.bin", row["sha256"].lower()), ("b.bin", "00")], "file_name string, sha256 string")
    compared = FS.verified(manifest, pinned)
    assert {r["file_name"]: r["matches"] for r in compared.collect()} == {"a.bin": True, "b.bin": False}
    with pytest.raises(ValueError, match="b.bin"):
        FS.require_verified(compared)
    FS.require_verified(compared.filter("file_name = 'a.bin'"))


def test_scalar_columns(spark):
    df = spark.createDataFrame(
        [("2004-02-29", "2023-02-28"), ("2004-02-29", "2023-02-27"), ("1958-01-01", "2023-01-01"), ("1958-01-02", "2023-01-01")],
        "b string, i string",
    )
    ages = [r[0] for r in df.select(C.completed_years(F.to_date("b"), F.to_date("i"))).collect()]
    assert ages == [19, 18, 65, 64]
    texts = spark.createDataFrame([("5.8",), ("abc",), ("6.55555",)], "v string")
    got = texts.select(C.whole_number(F.col("v")), C.scaled_number(F.col("v"))).collect()
    assert [r[0] for r in got] == [6, None, 7] and [r[1] for r in got] == [Decimal("5.8"), None, Decimal("6.5556")]
    tidy = spark.createDataFrame([(" a ",), ("None",), (" nan ",), ("",), ("none x",), ("NULL",)], "v string")
    assert [r[0] for r in tidy.select(C.tidy(F.col("v"))).collect()] == ["a", None, None, None, "none x", None]
    rate = spark.range(1).select(C.rate_percent(F.lit(14), F.lit(97)), C.rate_percent(F.lit(0), F.lit(0))).first()
    assert rate[0] == Decimal("14.43") and rate[1] is None


def small_core(spark):
    def df(rows, schema):
        parts = [p.strip().split() for p in schema.split(",")]
        text = spark.createDataFrame(rows, ", ".join(f"{name} string" for name, _ in parts))
        return text.select(*[F.col(name).cast(kind).alias(name) for name, kind in parts])

    patient = df(
        [("a", "1950-01-01", None), ("b", "1980-01-01", None), ("c", "1950-01-01", "2023-01-01"),
         ("d", "2023-01-01", None), ("e", "1950-01-01", None), ("f", "1950-01-01", "2023-06-01")],
        "patient_id string, birthdate date, deathdate date",
    )
    encounter = df(
        [("a", "emergency", "2020-01-01 00:00:00"), ("a", "inpatient", "2023-01-01 00:00:00"),
         ("b", "wellness", "2022-12-31 23:59:59"), ("b", "emergency", "2024-01-01 00:00:00"),
         ("c", "emergency", "2020-01-01 00:00:00"), ("f", "wellness", "2020-01-01 00:00:00"),
         ("e", "emergency", "2023-01-01 00:00:00")],
        "patient_id string, encounter_class string, start_ts timestamp_ntz",
    )
    condition = df(
        [("a", f"2020-01-{d:02d}", None if d < 8 else "2023-01-01") for d in range(1, 9)]
        + [("b", f"2020-01-{d:02d}", "2022-12-31") for d in range(1, 9)],
        "patient_id string, start_date date, stop_date date",
    )
    observation = df(
        [("a", "2022-01-01 00:00:00", "9", "1"), ("a", "2022-02-01 00:00:00", "6.5", "2"),
         ("b", "2022-01-01 00:00:00", "9", "3"), ("b", "2022-02-01 00:00:00", "high", "4"),
         ("f", "2022-02-01 00:00:00", "9", "5"), ("f", "2022-02-01 00:00:00", "6.4999", "6"),
         ("f", "2023-02-01 00:00:00", "9", "7")],
        "patient_id string, observation_ts timestamp_ntz, value_text string, source_file_row_number bigint",
    ).withColumn("code", F.lit("4548-4"))
    extra = {"encounter_id": F.lit("e"), "code": F.lit("c"), "description": F.lit("d"), "source_file_row_number": F.lit(1)}
    return {
        "patient": patient,
        "encounter": encounter.withColumns(extra),
        "condition": condition.withColumns(extra),
        "observation": observation.withColumns({"encounter_id": F.lit("e"), "description": F.lit("d")}),
    }


def test_cohort_rules(spark):
    core = small_core(spark)
    rows = {r["patient_id"]: r for r in K.risk_cohort(core).collect()}
    assert set(rows) == {"a", "b", "f"}
    a, b, f = rows["a"], rows["b"], rows["f"]
    assert a["point_total"] == 4 and a["event_flag"] == 1 and a["age_years_at_index"] == 73
    assert a["active_condition_count"] == 8 and a["last_value"] == Decimal("6.5")
    assert b["point_total"] == 0 and b["last_value"] is None and b["event_flag"] == 0
    assert f["point_total"] == 1 and f["last_value"] == Decimal("6.4999")
    score = {r["score_bucket"]: r for r in K.risk_score(core).collect()}
    assert [score[k]["patient_count"] for k in ("0", "1", "2", "3", "4", "GE_2")] == [1, 1, 0, 0, 1, 1]
    assert score["2"]["event_rate_pct"] is None and score["4"]["event_rate_pct"] == Decimal("100.00")
    top = score["0"]
    assert top["base_rate_pct"] == Decimal("33.33") and top["cohort_patient_count"] == 3
    assert (top["excluded_born_on_or_after_index"], top["excluded_dead_on_or_before_index"],
            top["excluded_no_prior_encounter"]) == (1, 1, 1)
    contract = K.risk_contract(core).orderBy("score").collect()
    assert [r["score"] for r in contract] == [0, 1, 2, 3, 4] and contract[4]["event_rate"] == Decimal("1.0000")
    assert contract[0]["ge2_patient_count"] == 1 and str(contract[0]["index_date"]) == "2023-01-01"
    assert K.risk_contract({**core, "patient": core["patient"].limit(0)}).first()["index_date"] is None


def test_gates_report_and_stop(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 1, "x"), ("b", 2, "y")], "k string, n int, v string")
    gates = G.union(
        [
            G.gate_rows(G.row_counts({"rows": df, "none": df.limit(0)}), {"rows": 3}),
            G.gate_rows(G.extra_rows(df, ("k", "n"), "extra"), {"extra": 1}),
            G.gate_rows(G.extra_rows(df, ("k", "v"), "keyless", blank_is_value=False), {"keyless": 1}),
            G.gate_rows(G.orphans(df, "v", df.filter("v = 'x'"), "v", "orphans"), {"orphans": 1}),
            G.gate_rows(G.orphans(df, "v", df.filter("v = 'x'"), "v", "strict", optional=False), {"strict": 2}),
            G.gate_rows(G.duplicate_groups(df, ("k", "n"), "twins"), {"twins": 1}),
            G.known_rows(df, {"found": 1}, found=F.col("v") == "y", absent=F.col("v") == "q"),
        ]
    )
    assert {r["status"] for r in gates.collect()} == {"PASS"}
    G.require_all(gates)
    failing = gates.unionByName(G.gate_rows(df.agg(F.max(F.lit(None).cast("int")).alias("nothing")), {}))
    assert G.report(failing).first()["check_name"] == "nothing"
    with pytest.raises(ValueError, match="1 failed gates: nothing"):
        G.require_all(failing)


def test_table_link_lineage_and_catalog_gates(spark, tmp_path):
    raw = {
        "patients": L.load_table(spark, write(tmp_path, "patients", PATIENTS), "patients", "b", NOW),
        "supplies": L.load_table(
            spark,
            write(tmp_path, "supplies", "DATE,PATIENT,ENCOUNTER,CODE,DESCRIPTION,QUANTITY\n2005-06-18,p1,e,c,d,1\n"
                                        "2005-06-18,zz,e,c,,1\n"),
            "supplies", "b", NOW,
        ),
    }
    core = {TABLES[n].view: conform.conformed(df, n) for n, df in raw.items()}
    found = {r["check_name"]: r["status"] for r in G.table_gates(raw, core, {"raw_patients_rows": 2, "raw_supplies_rows": 2}).collect()}
    assert found["raw_patients_rows"] == found["core_supply_matches_raw"] == found["unique_patients_id"] == "PASS"
    assert found["missing_supplies_description"] == "FAIL" and found["supply_business_key_extra_rows"] == "PASS"
    links = {r["check_name"]: r["actual_value"] for r in G.link_gates(raw, {}).collect()}
    assert links == {"orphan_supplies_patient": 1}
    small = small_core(spark)
    score = K.risk_score(small)
    assert G.lineage_gates(spark, {"risk_score": score}).first()["status"] == "PASS"
    touched = score.withColumn("section_loinc", F.lit("x"))
    assert G.lineage_gates(spark, {"risk_score": touched}).first()["status"] == "FAIL"
    catalog = G.catalog_gates(spark, ["patient", "sem_member"], ["patients"])
    assert {r["status"] for r in catalog.collect()} == {"PASS"}
    bad = {r["check_name"] for r in G.catalog_gates(spark, ["patients", "openfda_label"], ["patients"]).filter("status = 'FAIL'").collect()}
    assert bad == {"no_openfda_objects", "published_raw_tables", "published_member_view", "published_metric_model"}


def test_metric_layer(spark):
    model = S.MEMBER_MODEL
    assert model.named("Member ID") == "patient_id" and model.named("RxCUI") == "medication_code"
    assert model.path("claim_line", "patient") == ["claim_line", "claim", "patient"]
    assert model.path("condition", "patient") == ["condition", "patient"]
    with pytest.raises(KeyError):
        model.named("dose")
    tables = {
        "patient": spark.createDataFrame([("a", "F"), ("b", "M"), ("c", "M")], "patient_id string, gender string"),
        "encounter": spark.createDataFrame([("1", "a"), ("2", "a"), ("3", "zz")], "encounter_id string, patient_id string"),
        "claim": spark.createDataFrame([("x", "a", "1"), ("y", "b", "3")], "claim_id string, patient_id string, appointment_id string"),
    }
    got = {
        r["gender"]: (r["member_count"], r["encounter_count"])
        for r in S.metric_query(model, tables, ["member_count", "encounter_count"], ["gender"]).collect()
    }
    assert got == {"F": (1, 2), "M": (2, None), None: (None, 1)}
    total = S.metric_query(model, tables, ["member_count", "claim_count"]).first()
    assert (total["member_count"], total["claim_count"]) == (3, 2)
    with pytest.raises(ValueError):
        S.metric_query(model, tables, ["member_count"], ["encounter_id"])
