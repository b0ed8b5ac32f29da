"""The same conformed views in SQL, for comparison."""

from __future__ import annotations

import re

VIEWS = {
    "v_line": """
        SELECT l.*, o.o_custkey, o.o_orderdate,
               (l.l_orderkey * 8 + l.l_linenumber) * 1000000 + l.l_partkey * 31 + l.l_suppkey AS line_no
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""",
    "v_patient": """
        SELECT CAST(c.c_custkey AS VARCHAR) AS patient_id, CAST(d.first_order AS DATE) AS birthdate,
               CASE WHEN c.c_acctbal < 0 THEN CAST(d.last_order AS DATE) END AS deathdate,
               'Customer' || c.c_custkey AS first_name, 'Nation' || c.c_nationkey AS last_name,
               c.c_mktsegment AS gender, n.n_name AS city, r.r_name AS state
        FROM customer c
        LEFT JOIN (SELECT o_custkey, MIN(o_orderdate) AS first_order, MAX(o_orderdate) AS last_order
                   FROM orders GROUP BY o_custkey) d ON d.o_custkey = c.c_custkey
        LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
        LEFT JOIN region r ON r.r_regionkey = n.n_regionkey""",
    "v_encounter": """
        SELECT CAST(o_orderkey AS VARCHAR) AS encounter_id, o_orderdate AS start_ts,
               o_orderdate + INTERVAL 1 DAY AS stop_ts, CAST(o_custkey AS VARCHAR) AS patient_id,
               o_orderpriority AS encounter_class, CAST(100000000 + o_orderkey AS VARCHAR) AS code,
               'Order ' || o_orderstatus AS description,
               CAST(o_totalprice AS DECIMAL(18,2)) AS total_claim_cost, o_orderkey AS row_no
        FROM orders""",
    "v_condition": """
        SELECT CAST(o_orderdate AS DATE) AS start_date,
               CASE WHEN l_linestatus = 'F' THEN CAST(l_shipdate AS DATE) END AS stop_date,
               CAST(o_custkey AS VARCHAR) AS patient_id, CAST(l_orderkey AS VARCHAR) AS encounter_id,
               CAST(100000 + l_partkey AS VARCHAR) AS code,
               'Part ' || l_partkey || ' ' || l_returnflag AS description, line_no AS row_no
        FROM v_line""",
    "v_medication": """
        SELECT o_orderdate AS start_ts, l_shipdate AS stop_ts, CAST(o_custkey AS VARCHAR) AS patient_id,
               CAST(l_orderkey AS VARCHAR) AS encounter_id, CAST(100000 + l_partkey AS VARCHAR) AS code,
               'Part ' || l_partkey || CASE WHEN l_linenumber = 7 AND l_returnflag = 'R'
                                            THEN ' Fexofenadine' ELSE '' END AS description,
               CAST(l_quantity AS BIGINT) AS dispenses, CAST(l_extendedprice AS DECIMAL(18,2)) AS total_cost,
               line_no AS row_no
        FROM v_line""",
    "v_procedure": """
        SELECT l_shipdate AS start_ts, l_shipdate AS stop_ts, CAST(o_custkey AS VARCHAR) AS patient_id,
               CAST(l_orderkey AS VARCHAR) AS encounter_id, CAST(500000 + l_suppkey AS VARCHAR) AS code,
               'Supplier ' || l_suppkey AS description, l_returnflag AS reason_code,
               l_linestatus AS reason_description, line_no AS row_no
        FROM v_line""",
    "v_observation": """
        SELECT ts AS observation_ts, CAST(user_id AS VARCHAR) AS patient_id,
               CAST(NULL AS VARCHAR) AS encounter_id,
               CASE WHEN event_type <> 'error' THEN 'Laboratory' END AS category, event_type AS code,
               event_type || ' event' AS description,
               CASE WHEN event_type = 'view' THEN props ELSE CAST(value AS VARCHAR) END AS value_text,
               CASE WHEN event_type <> 'view' THEN 'points' END AS units, event_id AS row_no
        FROM events
        UNION ALL
        SELECT o_orderdate, CAST(o_custkey AS VARCHAR), CAST(o_orderkey AS VARCHAR), 'laboratory', 'total',
               'Order total',
               CASE WHEN o_orderstatus = 'P' THEN 'pending' ELSE CAST(o_totalprice AS VARCHAR) END,
               'currency', o_orderkey + 1000000000000
        FROM orders""",
    "v_allergy": """
        SELECT CAST(o_orderdate AS DATE) AS start_date, CAST(o_custkey AS VARCHAR) AS patient_id,
               CAST(o_orderkey AS VARCHAR) AS encounter_id, CAST(300000000 + o_orderkey AS VARCHAR) AS code,
               'Priority ' || o_orderpriority AS description, o_orderkey AS row_no
        FROM orders""",
    "v_careplan": """
        SELECT 'CP' || o_orderkey AS careplan_id, CAST(o_orderdate AS DATE) AS start_date,
               CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + 30 END AS stop_date,
               CAST(o_custkey AS VARCHAR) AS patient_id, CAST(o_orderkey AS VARCHAR) AS encounter_id,
               CAST(400000000 + o_orderkey AS VARCHAR) AS code, 'Plan ' || o_orderpriority AS description,
               o_orderstatus AS reason_code, CAST(NULL AS VARCHAR) AS reason_description, o_orderkey AS row_no
        FROM orders""",
    "v_immunization": """
        SELECT ts AS immunization_ts, CAST(user_id AS VARCHAR) AS patient_id,
               CASE WHEN event_type <> 'error' THEN 'E' || event_id END AS encounter_id,
               CAST(600000000 + event_id AS VARCHAR) AS code, 'Dose ' || event_type AS description,
               event_id AS row_no
        FROM events""",
    "v_device": """
        SELECT l_shipdate AS start_ts, CAST(o_custkey AS VARCHAR) AS patient_id,
               CAST(l_orderkey AS VARCHAR) AS encounter_id, CAST(500000 + l_suppkey AS VARCHAR) AS code,
               'Device ' || l_suppkey AS description, line_no AS row_no
        FROM v_line""",
    "v_imaging": """
        SELECT o_orderdate AS imaging_ts, CAST(o_custkey AS VARCHAR) AS patient_id,
               CAST(o_orderkey AS VARCHAR) AS encounter_id,
               CAST(700000000 + o_orderkey AS VARCHAR) AS procedure_code,
               o_orderpriority AS modality_description, o_orderkey AS row_no
        FROM orders""",
    "v_supply": """
        SELECT CAST(l_shipdate AS DATE) AS supply_date, CAST(o_custkey AS VARCHAR) AS patient_id,
               CAST(l_orderkey AS VARCHAR) AS encounter_id, CAST(100000 + l_partkey AS VARCHAR) AS code,
               'Supply ' || l_partkey AS description, line_no AS row_no
        FROM v_line""",
    "v_payer": "SELECT 'N' || n_nationkey AS payer_id, n_name AS payer_name FROM nation",
    "v_transition": """
        SELECT CAST(o.o_custkey AS VARCHAR) AS patient_id,
               CASE WHEN o.o_orderstatus <> 'P' THEN 'S' || o.o_orderkey END AS member_id,
               o.o_orderdate AS start_ts, o.o_orderdate + INTERVAL 365 DAY AS end_ts,
               'N' || c.c_nationkey AS payer_id, CAST(NULL AS VARCHAR) AS secondary_payer_id,
               o.o_orderpriority AS plan_ownership, CAST(NULL AS VARCHAR) AS owner_name
        FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey""",
    "v_coverage": """
        SELECT t.*, p.payer_name FROM v_transition t JOIN v_payer p ON p.payer_id = t.payer_id""",
    "v_claim": """
        SELECT g.l_orderkey || '-' || g.l_suppkey AS claim_id, CAST(o.o_custkey AS VARCHAR) AS patient_id,
               CAST(g.l_orderkey AS VARCHAR) AS appointment_id, g.service_ts,
               CAST(100000 + g.part AS VARCHAR) AS diagnosis_1, CAST(NULL AS VARCHAR) AS primary_payer_id
        FROM (SELECT l_orderkey, l_suppkey, MIN(l_shipdate) AS service_ts, MIN(l_partkey) AS part
              FROM lineitem GROUP BY l_orderkey, l_suppkey) g
        JOIN orders o ON o.o_orderkey = g.l_orderkey""",
    "v_claim_line": """
        SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS claim_line_id,
               l_orderkey || '-' || l_suppkey AS claim_id, CAST(o_custkey AS VARCHAR) AS patient_id,
               CAST(l_orderkey AS VARCHAR) AS appointment_id, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount,
               CAST(100000 + l_partkey AS VARCHAR) AS procedure_code, l_returnflag AS notes
        FROM v_line""",
    "v_cell_line": """
        SELECT DISTINCT o_custkey, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag FROM v_line""",
    "v_cell_coded": """
        SELECT CAST(o_custkey AS VARCHAR) AS patient_id,
               CASE l_returnflag WHEN 'R' THEN '11450-4' WHEN 'A' THEN '10160-0' ELSE '47519-4' END AS section_loinc,
               CASE l_returnflag WHEN 'R' THEN 'Problems' WHEN 'A' THEN 'Medications' ELSE 'Surgeries' END
                   AS section_title,
               CASE l_returnflag WHEN 'R' THEN 'conditions' WHEN 'A' THEN 'medications' ELSE 'procedures' END AS prefix,
               l_orderkey || lpad(CAST(l_linenumber AS VARCHAR), 2, '0')
                   || lpad(CAST(l_partkey AS VARCHAR), 12, '0') || lpad(CAST(l_suppkey AS VARCHAR), 10, '0') AS place,
               CASE WHEN l_returnflag IN ('R', 'A') THEN CAST(100000 + l_partkey AS VARCHAR)
                    ELSE CAST(500000 + l_suppkey AS VARCHAR) END AS code,
               CASE l_returnflag WHEN 'R' THEN 'Part ' || l_partkey || ' ' || l_returnflag
                    WHEN 'A' THEN 'Part ' || l_partkey ELSE 'Supplier ' || l_suppkey END AS label
        FROM v_cell_line""",
    "v_section": """
        SELECT patient_id AS document_id, patient_id, section_loinc, section_title,
               prefix || '-desc-' || place AS element_id, label AS text, code FROM v_cell_coded
        UNION ALL
        SELECT patient_id, patient_id, section_loinc, section_title, prefix || '-code-' || place,
               'http://www.nlm.nih.gov/research/umls/rxnorm ' || code, code FROM v_cell_coded
        UNION ALL
        SELECT CAST(o_custkey AS VARCHAR), CAST(o_custkey AS VARCHAR), '48765-2', 'Allergies',
               'allergies-desc-' || o_orderkey, 'Priority ' || o_orderpriority,
               CAST(300000000 + o_orderkey AS VARCHAR) FROM orders
        UNION ALL
        SELECT CAST(o_custkey AS VARCHAR), CAST(o_custkey AS VARCHAR), '48765-2', 'Allergies',
               'allergies-code-' || o_orderkey, 'http://snomed.info/sct ' || (300000000 + o_orderkey),
               CAST(300000000 + o_orderkey AS VARCHAR) FROM orders
        UNION ALL
        SELECT CAST(o_custkey AS VARCHAR), CAST(o_custkey AS VARCHAR), '48765-2', 'Allergies',
               'entry-assertion-' || o_orderkey, 'Allergy to substance',
               CAST(800000000 + o_orderkey AS VARCHAR) FROM orders
        UNION ALL
        SELECT CAST(o_custkey AS VARCHAR), CAST(o_custkey AS VARCHAR), '18776-5', 'Care Plans',
               'careplans-desc-' || o_orderkey, 'Plan ' || o_orderpriority,
               CAST(400000000 + o_orderkey AS VARCHAR) FROM orders
        UNION ALL
        SELECT CAST(o_custkey AS VARCHAR), CAST(o_custkey AS VARCHAR), '18776-5', 'Care Plans',
               'careplans-code-' || o_orderkey, 'http://snomed.info/sct ' || (400000000 + o_orderkey),
               CAST(400000000 + o_orderkey AS VARCHAR) FROM orders""",
    "v_claim_encounter": """
        SELECT e.patient_id, e.encounter_id, e.encounter_class, e.start_ts, e.description, c.claim_id,
               c.appointment_id, c.diagnosis_1, c.primary_payer_id, c.service_ts
        FROM v_claim c JOIN v_encounter e ON c.appointment_id = e.encounter_id AND c.patient_id = e.patient_id""",
    "v_feature": """
        SELECT 'ENCOUNTER' AS source_table, patient_id, encounter_id, code, description, start_ts AS event_ts,
               encounter_class AS event_class, CAST(NULL AS BOOLEAN) AS active_at_index,
               CAST(NULL AS VARCHAR) AS value_text, row_no AS source_file_row_number
        FROM v_encounter WHERE start_ts < TIMESTAMP '1999-01-01'
        UNION ALL
        SELECT 'CONDITION', patient_id, encounter_id, code, description, CAST(start_date AS TIMESTAMP), NULL,
               (stop_date IS NULL OR stop_date >= DATE '1999-01-01'), NULL, row_no
        FROM v_condition WHERE start_date < DATE '1999-01-01'
        UNION ALL
        SELECT 'MEDICATION', patient_id, encounter_id, code, description, start_ts, NULL, NULL, NULL, row_no
        FROM v_medication WHERE start_ts < TIMESTAMP '1999-01-01'
        UNION ALL
        SELECT 'OBSERVATION', patient_id, encounter_id, code, description, observation_ts, NULL, NULL,
               value_text, row_no
        FROM v_observation WHERE observation_ts < TIMESTAMP '1999-01-01'
        UNION ALL
        SELECT 'PROCEDURE', patient_id, encounter_id, code, description, start_ts, NULL, NULL, NULL, row_no
        FROM v_procedure WHERE start_ts < TIMESTAMP '1999-01-01'
        UNION ALL
        SELECT 'ALLERGY', patient_id, encounter_id, code, description, CAST(start_date AS TIMESTAMP), NULL,
               NULL, NULL, row_no
        FROM v_allergy WHERE start_date < DATE '1999-01-01'
        UNION ALL
        SELECT 'CAREPLAN', patient_id, encounter_id, code, description, CAST(start_date AS TIMESTAMP), NULL,
               NULL, NULL, row_no
        FROM v_careplan WHERE start_date < DATE '1999-01-01'
        UNION ALL
        SELECT 'IMMUNIZATION', patient_id, encounter_id, code, description, immunization_ts, NULL, NULL, NULL,
               row_no
        FROM v_immunization WHERE immunization_ts < TIMESTAMP '1999-01-01'
        UNION ALL
        SELECT 'DEVICE', patient_id, encounter_id, code, description, start_ts, NULL, NULL, NULL, row_no
        FROM v_device WHERE start_ts < TIMESTAMP '1999-01-01'
        UNION ALL
        SELECT 'IMAGING_STUDY', patient_id, encounter_id, procedure_code, modality_description, imaging_ts,
               NULL, NULL, NULL, row_no
        FROM v_imaging WHERE imaging_ts < TIMESTAMP '1999-01-01'
        UNION ALL
        SELECT 'SUPPLY', patient_id, encounter_id, code, description, CAST(supply_date AS TIMESTAMP), NULL,
               NULL, NULL, row_no
        FROM v_supply WHERE supply_date < DATE '1999-01-01'""",
    "v_cohort": """
        SELECT s.*, point_age + point_prior_acute_encounter + point_active_conditions + point_last_value
                    AS point_total
        FROM (
            SELECT e.patient_id, e.birthdate, e.age AS age_years_at_index,
                   CASE WHEN e.age >= 3 THEN 1 ELSE 0 END AS point_age,
                   CASE WHEN a.patient_id IS NOT NULL THEN 1 ELSE 0 END AS point_prior_acute_encounter,
                   COALESCE(c.n, 0) AS active_condition_count,
                   CASE WHEN COALESCE(c.n, 0) >= 3 THEN 1 ELSE 0 END AS point_active_conditions,
                   h.last_value,
                   CASE WHEN COALESCE(h.last_value >= 250000, FALSE) THEN 1 ELSE 0 END AS point_last_value,
                   CASE WHEN EXISTS (
                       SELECT 1 FROM v_encounter x WHERE x.patient_id = e.patient_id
                         AND x.encounter_class = '1-URGENT' AND x.start_ts >= TIMESTAMP '1999-01-01'
                         AND x.start_ts < TIMESTAMP '2000-01-01') THEN 1 ELSE 0 END AS event_flag
            FROM (
                SELECT p.patient_id, p.birthdate,
                       CAST(date_sub('year', p.birthdate, DATE '1999-01-01') AS INTEGER) AS age
                FROM v_patient p
                WHERE p.birthdate < DATE '1999-01-01'
                  AND (p.deathdate IS NULL OR p.deathdate > DATE '1999-01-01')
                  AND EXISTS (SELECT 1 FROM v_encounter x
                              WHERE x.patient_id = p.patient_id AND x.start_ts < TIMESTAMP '1999-01-01')
            ) e
            LEFT JOIN (SELECT DISTINCT patient_id FROM v_encounter
                       WHERE start_ts < TIMESTAMP '1999-01-01' AND encounter_class = '1-URGENT') a
                   ON a.patient_id = e.patient_id
            LEFT JOIN (SELECT patient_id, COUNT(*) AS n FROM v_condition
                       WHERE start_date < DATE '1999-01-01'
                         AND (stop_date IS NULL OR stop_date >= DATE '1999-01-01')
                       GROUP BY patient_id) c ON c.patient_id = e.patient_id
            LEFT JOIN (SELECT patient_id, TRY_CAST(value_text AS DECIMAL(18,4)) AS last_value
                       FROM v_observation
                       WHERE observation_ts < TIMESTAMP '1999-01-01' AND code = 'total'
                       QUALIFY ROW_NUMBER() OVER (PARTITION BY patient_id
                                                  ORDER BY observation_ts DESC, row_no DESC) = 1) h
                   ON h.patient_id = e.patient_id
        ) s""",
    "v_score": """
        SELECT b.score_bucket, b.sort_order, b.patient_count, b.event_count,
               CAST(ROUND(100.0 * b.event_count / NULLIF(b.patient_count, 0), 2) AS DECIMAL(7,2)) AS event_rate_pct,
               t.n AS cohort_patient_count, t.e AS cohort_event_count,
               CAST(ROUND(100.0 * t.e / NULLIF(t.n, 0), 2) AS DECIMAL(7,2)) AS base_rate_pct,
               x.born AS excluded_born_on_or_after_index, x.dead AS excluded_dead_on_or_before_index,
               x.fresh AS excluded_no_prior_encounter,
               'Point count, not a validated stratifier and not a care recommendation. '
               || 'Score 2 sits below score 1 on this extract.' AS score_statement
        FROM (
            SELECT CAST(s.score AS VARCHAR) AS score_bucket, s.score AS sort_order,
                   COUNT(c.patient_id) AS patient_count, CAST(COALESCE(SUM(c.event_flag), 0) AS BIGINT) AS event_count
            FROM (SELECT unnest([0, 1, 2, 3, 4]) AS score) s LEFT JOIN v_cohort c ON c.point_total = s.score
            GROUP BY s.score
            UNION ALL
            SELECT 'GE_2', 5, COUNT(*), CAST(COALESCE(SUM(event_flag), 0) AS BIGINT)
            FROM v_cohort WHERE point_total >= 2
        ) b
        CROSS JOIN (SELECT COUNT(*) AS n, CAST(COALESCE(SUM(event_flag), 0) AS BIGINT) AS e FROM v_cohort) t
        CROSS JOIN (
            SELECT COUNT(*) FILTER (birthdate >= DATE '1999-01-01') AS born,
                   COUNT(*) FILTER (birthdate < DATE '1999-01-01' AND deathdate <= DATE '1999-01-01') AS dead,
                   COUNT(*) FILTER (birthdate < DATE '1999-01-01'
                       AND (deathdate IS NULL OR deathdate > DATE '1999-01-01')
                       AND patient_id NOT IN (SELECT patient_id FROM v_encounter
                                              WHERE start_ts < TIMESTAMP '1999-01-01')) AS fresh
            FROM v_patient) x""",
}


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """The statement with the views it uses, and those they use, as a WITH clause."""
    known = {**VIEWS, **(extra or {})}
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bv_\w+", text):
            if name in known and name not in ordered:
                visit(known[name])
                if name not in ordered:
                    ordered.append(name)

    visit(body)
    clauses = ",\n".join(f"{name} AS ({known[name]})" for name in ordered)
    return f"WITH {clauses}\n{body}" if ordered else body
