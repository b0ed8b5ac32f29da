"""The columns of each source file, one line each: name, type, nullable, name in the view."""

from __future__ import annotations

COLUMNS: dict[str, str] = {}

# Fixed values.
COLUMNS["patients"] = """
ID string required patient_id
BIRTHDATE date required birthdate
DEATHDATE date null deathdate
SSN string required ssn
DRIVERS string null drivers
PASSPORT string null passport
PREFIX string null prefix
FIRST string required first
MIDDLE string null middle
LAST string required last
SUFFIX string null suffix
MAIDEN string null maiden
MARITAL string null marital
RACE string required race
ETHNICITY string required ethnicity
GENDER string required gender
BIRTHPLACE string required birthplace
ADDRESS string required address
CITY string required city
STATE string required state
COUNTY string required county
FIPS string null fips
ZIP string required zip
LAT decimal(20,15) required latitude
LON decimal(20,15) required longitude
HEALTHCARE_EXPENSES decimal(18,2) required healthcare_expenses
HEALTHCARE_COVERAGE decimal(18,2) required healthcare_coverage
INCOME bigint required income
"""

# Fixed values.
COLUMNS["encounters"] = """
ID string required encounter_id
START timestamp_ntz required start_ts
STOP timestamp_ntz required stop_ts
PATIENT string required patient_id
ORGANIZATION string required organization_id
PROVIDER string required provider_id
PAYER string required payer_id
ENCOUNTERCLASS string required encounter_class
CODE string required code
DESCRIPTION string required description
BASE_ENCOUNTER_COST decimal(18,2) required base_encounter_cost
TOTAL_CLAIM_COST decimal(18,2) required total_claim_cost
PAYER_COVERAGE decimal(18,2) required payer_coverage
REASONCODE string null reason_code
REASONDESCRIPTION string null reason_description
"""

# Fixed values.
COLUMNS["conditions"] = """
START date required start_date
STOP date null stop_date
PATIENT string required patient_id
ENCOUNTER string required encounter_id
SYSTEM string required code_system
CODE string required code
DESCRIPTION string required description
"""

# Fixed values.
COLUMNS["medications"] = """
START timestamp_ntz required start_ts
STOP timestamp_ntz null stop_ts
PATIENT string required patient_id
PAYER string required payer_id
ENCOUNTER string required encounter_id
CODE string required code
DESCRIPTION string required description
BASE_COST decimal(18,2) required base_cost
PAYER_COVERAGE decimal(18,2) required payer_coverage
DISPENSES bigint required dispenses
TOTALCOST decimal(18,2) required total_cost
REASONCODE string null reason_code
REASONDESCRIPTION string null reason_description
"""

# Fixed values.
COLUMNS["observations"] = """
DATE timestamp_ntz required observation_ts
PATIENT string required patient_id
ENCOUNTER string null encounter_id
CATEGORY string null category
CODE string required code
DESCRIPTION string required description
VALUE string required value_text
UNITS string null units
TYPE string required value_type
"""

# Fixed values.
COLUMNS["procedures"] = """
START timestamp_ntz required start_ts
STOP timestamp_ntz required stop_ts
PATIENT string required patient_id
ENCOUNTER string required encounter_id
SYSTEM string required code_system
CODE string required code
DESCRIPTION string required description
BASE_COST decimal(18,2) required base_cost
REASONCODE string null reason_code
REASONDESCRIPTION string null reason_description
"""

# Fixed values.
COLUMNS["allergies"] = """
START date required start_date
STOP date null stop_date
PATIENT string required patient_id
ENCOUNTER string required encounter_id
CODE string required code
SYSTEM string required code_system
DESCRIPTION string required description
TYPE string required allergy_type
CATEGORY string required category
REACTION1 string null reaction_1_code
DESCRIPTION1 string null reaction_1_description
SEVERITY1 string null reaction_1_severity
REACTION2 string null reaction_2_code
DESCRIPTION2 string null reaction_2_description
SEVERITY2 string null reaction_2_severity
"""

# Fixed values.
COLUMNS["careplans"] = """
ID string required careplan_id
START date required start_date
STOP date null stop_date
PATIENT string required patient_id
ENCOUNTER string required encounter_id
CODE string required code
DESCRIPTION string required description
REASONCODE string null reason_code
REASONDESCRIPTION string null reason_description
"""

# Fixed values.
COLUMNS["immunizations"] = """
DATE timestamp_ntz required immunization_ts
PATIENT string required patient_id
ENCOUNTER string required encounter_id
CODE string required code
DESCRIPTION string required description
BASE_COST decimal(18,2) required base_cost
"""

# Fixed values.
COLUMNS["imaging_studies"] = """
ID string required imaging_study_id
DATE timestamp_ntz required imaging_ts
PATIENT string required patient_id
ENCOUNTER string required encounter_id
SERIES_UID string required series_uid
BODYSITE_CODE string required body_site_code
BODYSITE_DESCRIPTION string required body_site_description
MODALITY_CODE string required modality_code
MODALITY_DESCRIPTION string required modality_description
INSTANCE_UID string required instance_uid
SOP_CODE string required sop_code
SOP_DESCRIPTION string required sop_description
PROCEDURE_CODE string required procedure_code
"""

# Fixed values.
COLUMNS["devices"] = """
START timestamp_ntz required start_ts
STOP timestamp_ntz null stop_ts
PATIENT string required patient_id
ENCOUNTER string required encounter_id
CODE string required code
DESCRIPTION string required description
UDI string required udi
"""

# Fixed values.
COLUMNS["supplies"] = """
DATE date required supply_date
PATIENT string required patient_id
ENCOUNTER string required encounter_id
CODE string required code
DESCRIPTION string required description
QUANTITY bigint required quantity
"""

# Fixed values.
COLUMNS["payer_transitions"] = """
PATIENT string required patient_id
MEMBERID string null member_id
START_DATE timestamp_ntz required start_ts
END_DATE timestamp_ntz required end_ts
PAYER string required payer_id
SECONDARY_PAYER string null secondary_payer_id
PLAN_OWNERSHIP string null plan_ownership
OWNER_NAME string null owner_name
"""

# Fixed values.
COLUMNS["payers"] = """
ID string required payer_id
NAME string required payer_name
OWNERSHIP string required ownership
ADDRESS string null address
CITY string null city
STATE_HEADQUARTERED string null state_headquartered
ZIP string null zip
PHONE string null phone
AMOUNT_COVERED decimal(18,2) required amount_covered
AMOUNT_UNCOVERED decimal(18,2) required amount_uncovered
REVENUE decimal(18,2) required revenue
COVERED_ENCOUNTERS bigint required covered_encounters
UNCOVERED_ENCOUNTERS bigint required uncovered_encounters
COVERED_MEDICATIONS bigint required covered_medications
UNCOVERED_MEDICATIONS bigint required uncovered_medications
COVERED_PROCEDURES bigint required covered_procedures
UNCOVERED_PROCEDURES bigint required uncovered_procedures
COVERED_IMMUNIZATIONS bigint required covered_immunizations
UNCOVERED_IMMUNIZATIONS bigint required uncovered_immunizations
UNIQUE_CUSTOMERS bigint required unique_customers
QOLS_AVG decimal(18,16) required qols_avg
MEMBER_MONTHS bigint required member_months
"""

# Fixed values.
COLUMNS["organizations"] = """
ID string required organization_id
NAME string required organization_name
ADDRESS string required address
CITY string required city
STATE string required state
ZIP string required zip
LAT decimal(20,15) required latitude
LON decimal(20,15) required longitude
PHONE string required phone
REVENUE decimal(18,2) required revenue
UTILIZATION bigint required utilization
NPI string required npi
"""

# Fixed values.
COLUMNS["providers"] = """
ID string required provider_id
ORGANIZATION string required organization_id
NAME string required provider_name
GENDER string required gender
SPECIALITY string required speciality
ADDRESS string required address
CITY string required city
STATE string required state
ZIP string required zip
LAT decimal(20,15) required latitude
LON decimal(20,15) required longitude
ENCOUNTERS bigint required recorded_encounter_count
PROCEDURES bigint required recorded_procedure_count
NPI string required npi
"""

# Fixed values.
COLUMNS["claims"] = """
ID string required claim_id
PATIENTID string required patient_id
PROVIDERID string required provider_id
PRIMARYPATIENTINSURANCEID string null primary_payer_id
SECONDARYPATIENTINSURANCEID string null secondary_payer_id
DEPARTMENTID bigint required department_id
PATIENTDEPARTMENTID bigint required patient_department_id
DIAGNOSIS1 string required diagnosis_1
DIAGNOSIS2 string null diagnosis_2
DIAGNOSIS3 string null diagnosis_3
DIAGNOSIS4 string null diagnosis_4
DIAGNOSIS5 string null diagnosis_5
DIAGNOSIS6 string null diagnosis_6
DIAGNOSIS7 string null diagnosis_7
DIAGNOSIS8 string null diagnosis_8
REFERRINGPROVIDERID string null referring_provider_id
APPOINTMENTID string required appointment_id
CURRENTILLNESSDATE timestamp_ntz required current_illness_ts
SERVICEDATE timestamp_ntz required service_ts
SUPERVISINGPROVIDERID string required supervising_provider_id
STATUS1 string required status_1
STATUS2 string null status_2
STATUSP string required status_patient
OUTSTANDING1 decimal(18,2) required outstanding_1
OUTSTANDING2 decimal(18,2) null outstanding_2
OUTSTANDINGP decimal(18,2) required outstanding_patient
LASTBILLEDDATE1 timestamp_ntz required last_billed_ts_1
LASTBILLEDDATE2 timestamp_ntz null last_billed_ts_2
LASTBILLEDDATEP timestamp_ntz required last_billed_ts_patient
HEALTHCARECLAIMTYPEID1 bigint required claim_type_id_1
HEALTHCARECLAIMTYPEID2 bigint required claim_type_id_2
"""

# Fixed values.
COLUMNS["claims_transactions"] = """
ID string required claim_line_id
CLAIMID string required claim_id
CHARGEID bigint required charge_id
PATIENTID string required patient_id
TYPE string required line_type
AMOUNT decimal(18,2) null amount
METHOD string null payment_method
FROMDATE timestamp_ntz required from_ts
TODATE timestamp_ntz required to_ts
PLACEOFSERVICE string required place_of_service_id
PROCEDURECODE string required procedure_code
MODIFIER1 string null modifier_1
MODIFIER2 string null modifier_2
DIAGNOSISREF1 bigint required diagnosis_ref_1
DIAGNOSISREF2 bigint null diagnosis_ref_2
DIAGNOSISREF3 bigint null diagnosis_ref_3
DIAGNOSISREF4 bigint null diagnosis_ref_4
UNITS bigint required units
DEPARTMENTID bigint required department_id
NOTES string required notes
UNITAMOUNT decimal(18,2) required unit_amount
TRANSFEROUTID bigint null transfer_out_id
TRANSFERTYPE string null transfer_type
PAYMENTS decimal(18,2) required payments
ADJUSTMENTS decimal(18,2) required adjustments
TRANSFERS decimal(18,2) null transfers
OUTSTANDING decimal(18,2) required outstanding
APPOINTMENTID string required appointment_id
LINENOTE string null line_note
PATIENTINSURANCEID string null patient_insurance_id
FEESCHEDULEID bigint required fee_schedule_id
PROVIDERID string required provider_id
SUPERVISINGPROVIDERID string required supervising_provider_id
"""

# Fixed values.
COLUMNS["document_section"] = """
DOCUMENT_ID string required document_id
PATIENT_ID string required patient_id
EFFECTIVE_TIME string null effective_time
SECTION_LOINC string required section_loinc
SECTION_TITLE string required section_title
ELEMENT_ID string required element_id
TEXT string required text
CODE string null code
CODE_SYSTEM string null code_system
SOURCE_FILE string required ccda_source_file
ELEMENT_ROLE string required element_role
ROW_START string null row_start
ROW_STOP string null row_stop
ROW_VALUE string null row_value
NARRATIVE_CODE string null narrative_code
NARRATIVE_SYSTEM_URI string null narrative_system_uri
CODE_SYSTEM_NAME string null code_system_name
STRUCTURED_CODE string null structured_code
STRUCTURED_CODE_SYSTEM string null structured_code_system
REJECTED_CODES string null rejected_codes
QUOTE_SAFE string required quote_safe
CSV_TABLE string null csv_table
CSV_MATCH string null csv_match
CSV_ENCOUNTER string null csv_encounter
CSV_START string null csv_start
ORDINAL bigint required ordinal
"""
