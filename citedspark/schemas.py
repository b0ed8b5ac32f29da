"""Declared knowledge about the flat files: columns, keys, links and names.

A file's header must name the declared columns in their order; `source_columns` has each
column's type, whether it may be empty and its conformed name.
"""

from __future__ import annotations

from dataclasses import dataclass

from citedspark.source_columns import COLUMNS

LINEAGE = ("source_filename", "source_file_row_number", "loaded_at", "load_batch_id")


def _declared(file: str) -> dict[str, tuple[str, bool, str]]:
    lines = (line.split() for line in COLUMNS[file].strip().splitlines())
    return {name: (kind, empty == "null", view) for name, kind, empty, view in lines}


@dataclass(frozen=True)
class Table:
    """One source file, its keys and its conformed view."""

    file: str
    view: str
    primary_key: tuple[str, ...] = ()
    business_key: tuple[str, ...] = ()
    multi_line: bool = False

    @property
    def columns(self) -> dict[str, tuple[str, bool, str]]:
        """Type, whether it may be empty and conformed name, by column, in file order."""
        return _declared(self.file)

    def column_type(self, column: str) -> str:
        return self.columns[column.upper()][0]

    def is_nullable(self, column: str) -> bool:
        known = self.columns.get(column.upper())
        return known is not None and known[1]

    def view_name(self, column: str) -> str:
        """The conformed name; a column that is not declared keeps its own."""
        known = self.columns.get(column.upper())
        return column.lower() if known is None else known[2]

    def check_header(self, header: list[str]) -> None:
        """Stop unless the header names the declared columns in their order, in any case."""
        found, wanted = [name.upper() for name in header], list(self.columns)
        if found == wanted:
            return
        lacking = [name for name in wanted if name not in found]
        extra = [name for name in found if name not in wanted]
        raise ValueError(
            f"{self.file}: the header differs from the declared columns; missing {lacking}, not declared {extra}"
            + ("" if lacking or extra else ", another order")
        )


# The member view is an allow-list, so a new source column is never exposed by accident.
MEMBER_COLUMNS = {
    "ID": "patient_id",
    "BIRTHDATE": "birthdate",
    "DEATHDATE": "deathdate",
    "FIRST": "first_name",
    "LAST": "last_name",
    "GENDER": "gender",
    "CITY": "city",
    "STATE": "state",
}

# --- Fixed values: the source tables -------------------------------------------
TABLES = {
    table.file: table
    for table in (
        Table("patients", "patient", ("ID",)),
        Table("encounters", "encounter", ("ID",)),
        Table("conditions", "condition", business_key=("PATIENT", "ENCOUNTER", "CODE", "START")),
        Table("medications", "medication", business_key=("PATIENT", "ENCOUNTER", "CODE", "START")),
        Table("observations", "observation", business_key=("PATIENT", "ENCOUNTER", "CODE", "DATE", "VALUE")),
        Table("procedures", "procedure"),
        Table("allergies", "allergy", business_key=("PATIENT", "ENCOUNTER", "CODE", "START")),
        Table("careplans", "careplan", ("ID",)),
        Table("immunizations", "immunization"),
        Table("imaging_studies", "imaging_study", ("ID", "SERIES_UID", "INSTANCE_UID")),
        Table("devices", "device"),
        Table("supplies", "supply", business_key=("PATIENT", "ENCOUNTER", "CODE", "DATE")),
        Table("payer_transitions", "payer_transition"),
        Table("payers", "payer", ("ID",)),
        Table("organizations", "organization", ("ID",)),
        Table("providers", "provider", ("ID",)),
        Table("claims", "claim", ("ID",)),
        Table("claims_transactions", "claim_line", ("ID",)),
        Table("document_section", "document_section", ("DOCUMENT_ID", "ELEMENT_ID"), multi_line=True),
    )
}

# --- Fixed values: links, child table -> {child column: parent table} ----------
LINKS = {
    "encounters": {
        "PATIENT": "patients",
        "ORGANIZATION": "organizations",
        "PROVIDER": "providers",
        "PAYER": "payers",
    },
    "claims": {
        "PATIENTID": "patients",
        "APPOINTMENTID": "encounters",
        "PROVIDERID": "providers",
        "SUPERVISINGPROVIDERID": "providers",
        "PRIMARYPATIENTINSURANCEID": "payers",
        "SECONDARYPATIENTINSURANCEID": "payers",
    },
    "claims_transactions": {
        "CLAIMID": "claims",
        "PATIENTID": "patients",
        "APPOINTMENTID": "encounters",
        "PROVIDERID": "providers",
        "PLACEOFSERVICE": "organizations",
    },
    "providers": {"ORGANIZATION": "organizations"},
    "payer_transitions": {"PATIENT": "patients", "PAYER": "payers", "SECONDARY_PAYER": "payers"},
    "conditions": {"PATIENT": "patients", "ENCOUNTER": "encounters"},
    "medications": {"PATIENT": "patients", "ENCOUNTER": "encounters"},
    "procedures": {"PATIENT": "patients", "ENCOUNTER": "encounters"},
    "allergies": {"PATIENT": "patients", "ENCOUNTER": "encounters"},
    "careplans": {"PATIENT": "patients", "ENCOUNTER": "encounters"},
    "immunizations": {"PATIENT": "patients", "ENCOUNTER": "encounters"},
    "imaging_studies": {"PATIENT": "patients", "ENCOUNTER": "encounters"},
    "devices": {"PATIENT": "patients", "ENCOUNTER": "encounters"},
    "supplies": {"PATIENT": "patients", "ENCOUNTER": "encounters"},
    "observations": {"PATIENT": "patients", "ENCOUNTER": "encounters"},
}
