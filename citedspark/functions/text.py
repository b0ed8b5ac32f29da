"""Text screening as native column expressions, so it stays inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citedspark import fixed_values as fv

# Case-blind, with Unicode word boundaries and classes.
_FLAGS = "(?iU)"


def squeezed(text: Column) -> Column:
    """Trimmed, with every run of white space as one blank."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def _found(text: Column, pattern: str) -> Column:
    return text.rlike(_FLAGS + pattern)


def refusal_classes(text: Column) -> Column:
    """Every refusal class a squeezed question triggers, in reporting order."""
    changes_medication = (
        _found(text, fv.NEW_PRESCRIPTION_PATTERN)
        | _found(text, fv.START_MEDICATION_PATTERN)
        | (_found(text, fv.MEDICATION_CHANGE_VERB) & _found(text, fv.MEDICATION_CHANGE_OBJECT))
    )
    triggered = (
        changes_medication,
        _found(text, fv.DISCHARGE_PATTERN),
        _found(text, fv.EXTERNAL_PATTERN),
        _found(text, fv.TREATMENT_PATTERN),
    )
    return F.array_compact(
        F.array(*[F.when(hit, F.lit(name)) for name, hit in zip(fv.REFUSALS, triggered)])
    )


def question_intent(text: Column, refusals: Column) -> Column:
    """The first refusal, else the first answerable class found in a squeezed question, else no_citation."""
    answerable = [F.when(_found(text, pattern), F.lit(name)) for name, pattern in fv.ANSWER_INTENTS]
    return F.coalesce(F.try_element_at(refusals, F.lit(1)), *answerable, F.lit(fv.NO_CITATION))


def refusal_text(refusals: Column) -> Column:
    """One message per triggered class, joined by blanks."""
    messages = F.create_map(
        *[F.lit(part) for name in fv.REFUSALS for part in (name, fv.REFUSAL_TEXT[name])]
    )
    return F.array_join(F.transform(refusals, lambda name: messages[name]), " ")


def named_person(question: Column) -> tuple[Column, Column]:
    """First and last name when two words of letters followed by digits stand together."""
    pattern = "(?U)" + fv.PERSON_PATTERN
    return tuple(
        F.nullif(F.regexp_extract(question, pattern, group), F.lit("")) for group in (1, 2)
    )


def named_day(question: Column) -> Column:
    """A calendar day as yyyy-MM-dd: the ISO form first, else '18 June 2005'."""
    iso = F.nullif(F.regexp_extract(question, "(?U)" + fv.ISO_DAY_PATTERN, 1), F.lit(""))
    long_form = _FLAGS + r"\b(\d{1,2})\s+(" + "|".join(fv.MONTHS) + r")\s+(\d{4})\b"
    day, month, year = (F.regexp_extract(question, long_form, group) for group in (1, 2, 3))
    number = F.array_position(F.array(*[F.lit(name) for name in fv.MONTHS]), F.lower(month))
    return F.coalesce(
        iso,
        F.when(
            year != "",
            F.concat_ws("-", year, F.lpad(number.cast("string"), 2, "0"), F.lpad(day, 2, "0")),
        ),
    )


def code_runs(text: Column, shortest: int = 6, longest: int = 18, timestamps_from: int = 12) -> Column:
    """Distinct digit runs that can be codes, in order; timestamp-length runs are dropped."""
    runs = F.regexp_extract_all(text, F.lit(rf"(\d{{{shortest},{longest}}})"), F.lit(1))
    kept = F.array_distinct(F.filter(runs, lambda run: F.length(run) < timestamps_from))
    return F.coalesce(kept, F.array().cast("array<string>"))


def codes_overlap(left: Column, right: Column) -> Column:
    return F.arrays_overlap(code_runs(left), code_runs(right))


def conflicting_codes(quoted: Column, candidates: Column) -> Column:
    """Codes found in an array of texts, without those of the quoted code."""
    found = F.flatten(F.transform(candidates, lambda text: code_runs(text)))
    return F.array_except(found, code_runs(quoted))


def has_banned_claim(text: Column) -> Column:
    """A care, validation or dose claim that is left after the permitted negations go."""
    rest = F.lower(text)
    for negation in fv.ALLOWED_NEGATIONS:
        # Of letters and blanks only. As a pattern it is searched in leaps, as a plain text byte by byte.
        rest = F.regexp_replace(rest, negation, "")
    # One pattern, so the shortened text is made and searched once; its claims are tried where one can begin.
    begins = "".join(sorted({claim[0] for claim in fv.BANNED_CLAIMS}))
    return rest.rlike(f"(?=[{begins}])(?:" + "|".join(fv.BANNED_CLAIMS) + ")")


def percent_text(fraction: Column) -> Column:
    return F.format_string("%.2f%%", fraction.cast("double") * 100)


def is_whole(number: Column) -> Column:
    value = number.try_cast("double")
    return value.isNotNull() & (value == F.floor(value))


def whole_text(number: Column) -> Column:
    return number.try_cast("double").cast("long").cast("string")


# --- Document element names ---------------------------------------------------
def element_part(element_id: Column, group: int) -> Column:
    return F.regexp_extract(element_id, fv.ELEMENT_ID_PATTERN, group)


def element_prefix(element_id: Column) -> Column:
    return element_part(element_id, 1)


def element_role(element_id: Column) -> Column:
    kind = element_part(element_id, 2)
    return (
        F.when(kind == "desc", F.lit("description")).when(kind == "code", F.lit("code")).otherwise("other")
    )


def paired_element(element_id: Column) -> Column:
    """The code cell of a description cell and the reverse; blank when it has no pair."""
    kind = element_part(element_id, 2)
    other = F.when(kind == "desc", F.lit("code")).otherwise(F.lit("desc"))
    return F.when(kind == "", F.lit("")).otherwise(
        F.concat_ws("-", element_part(element_id, 1), other, element_part(element_id, 3))
    )


def stated_code(text: Column) -> tuple[Column, Column]:
    """(code, system) of a cell that reads '<system> <code>'."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    return (
        F.regexp_extract(trimmed, fv.CODE_TEXT_PATTERN, 2),
        F.regexp_extract(trimmed, fv.CODE_TEXT_PATTERN, 1),
    )


def code_system_part(uri: Column, part: int) -> Column:
    """Object identifier (0) or name (1) of a system URI, blank when unknown."""
    known = F.create_map(
        *[F.lit(item) for name, pair in fv.CODE_SYSTEMS.items() for item in (name, pair[part])]
    )
    return F.coalesce(known[uri], F.lit(""))


def file_uuid(path: Column) -> Column:
    return F.regexp_extract(path, fv.FILE_UUID_PATTERN, 1)


def day_of(stamp: Column) -> Column:
    """The day part of a longer date text, NULL when it has another shape."""
    return F.when(
        (F.length(stamp) > 10) & (F.substring(stamp, 5, 1) == "-") & (F.substring(stamp, 8, 1) == "-"),
        F.substring(stamp, 1, 10),
    )
