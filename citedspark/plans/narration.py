"""Prompts bounded to cited rows, and the filter that accepts or discards a narration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citedspark import fixed_values as fv
from citedspark.functions import text as X
from citedspark.functions.citations import rendered
from citedspark.operators.guard import unguarded
from citedspark.operators.ranking import top_rows
from citedspark.session import written


def _listed(column: str):
    return F.when(F.size(column) > 0, F.array_join(column, ", ")).otherwise("none")


#: Rows of a prompt, and bytes of their JSON, at most.
PROMPT_ROWS, PROMPT_BYTES = 50, 65_536


def narration_prompts(
    answers: DataFrame, rows: DataFrame, most_rows: int = PROMPT_ROWS, most_bytes: int = PROMPT_BYTES
) -> DataFrame:
    """(question_id, prompt, rows_shown, rows_left_out) for cited answers with rows.

    `rows` has question_id and `row`, a struct; its fields go out as text in name order, null where
    null. A prompt shows the first rows in the order of those fields, as many as `most_rows` and
    `most_bytes` of JSON allow, so a question with very many rows is cut before it is gathered.
    """
    fields = sorted(rows.schema["row"].dataType.fieldNames())
    usable = answers.filter(
        (F.col("status") == "cited") & F.col("narration_allowed") & (F.size("citations") > 0)
    )
    told = rows.join(usable.select("question_id"), "question_id", "left_semi").select(
        "question_id", *[F.col(f"row.`{name}`").cast("string").alias(f"_{n}") for n, name in enumerate(fields)]
    )
    order = [F.col(f"_{n}").asc_nulls_first() for n in range(len(fields))]
    totals = told.groupBy("question_id").agg(F.count("*").alias("_rows"))
    first = top_rows(told, ["question_id"], order, most_rows, "_place")
    item = F.to_json(F.struct(*[F.col(f"_{n}").alias(name) for n, name in enumerate(fields)]), {"ignoreNullFields": "false"})
    so_far = Window.partitionBy("question_id").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    shown = first.select("question_id", "_place", item.alias("_item")).withColumn(
        "_bytes", F.sum(F.octet_length("_item") + 1).over(so_far)
    ).where(F.col("_bytes") < most_bytes)
    payload = shown.groupBy("question_id").agg(
        F.array_sort(F.collect_list(F.struct("_place", "_item"))).alias("_items")
    )
    listed = F.concat(F.lit("["), F.array_join("_items._item", ","), F.lit("]"))
    return usable.join(payload, "question_id").join(totals, "question_id").select(
        "question_id",
        F.concat(
            F.lit(fv.NARRATION_RULES + "\n\nQuestion: "), F.col("question"),
            F.lit("\nquoted_codes: "), _listed("quoted_codes"),
            F.lit("\nrejected_codes: "), _listed("rejected_codes"),
            F.lit("\nCitations: "), F.to_json(F.transform("citations", rendered)),
            F.lit("\nRows: "), listed, F.lit("\n"),
        ).alias("prompt"),
        F.size("_items").cast("long").alias("rows_shown"),
        (F.col("_rows") - F.size("_items")).alias("rows_left_out"),
    )


#: What a narration is judged by, beside its text.
JUDGED_BY = ["status", "citations", "quoted_codes", "rejected_codes"]


def judged(told: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, accepted) of the rows of (keys, narration, JUDGED_BY); rows of equal keys are equal.

    Every citation and quoted code is kept, every mention of a rejected code is negated, and
    there is no claim and no outside label. Mentions are found in one pass over the texts of
    the narrations that have rejected codes at all; only those texts are written, once, beside the keys.
    """
    said = F.col("narration")
    keep = (
        (F.col("status") == "cited")
        & (F.trim(said) != "")
        & F.forall("citations", lambda cited: said.contains(rendered(cited)))
        & F.forall("quoted_codes", lambda code: said.contains(code))
        & ~said.rlike("(?iU)" + fv.EXTERNAL_LABEL_PATTERN)
        & ~X.has_banned_claim(said)
    )
    doubtful = F.col("_keep") & (F.size("rejected_codes") > 0) & (F.size("quoted_codes") > 0)
    seen = written(
        told.withColumn("_keep", F.coalesce(keep, F.lit(False))).select(
            *keys, "_keep", F.when(doubtful, said).alias("_said"),
            F.when(doubtful, F.array_distinct("rejected_codes")).alias("_codes"),
        ),
        "judged",
    )
    guarded = seen.where(F.col("_codes").isNotNull()).dropDuplicates(keys)
    rejected = guarded.select(*keys, F.explode("_codes").alias("code"))
    bare = unguarded(guarded.withColumn("_line", F.lit(0)), rejected, keys, ["_line"], "_said")
    failed = bare.where("unguarded > 0").select(*keys, F.lit(True).alias("_failed"))
    return seen.join(failed, keys, "left").select(*keys, (F.col("_keep") & F.col("_failed").isNull()).alias("accepted"))


def accepted_narrations(narrations: DataFrame, answers: DataFrame) -> DataFrame:
    """(question_id, narration, accepted) of every narration; an answer may have several."""
    told = narrations.join(answers.select("question_id", *JUDGED_BY), "question_id")
    return judged(told, ["question_id", "narration"]).select("question_id", "narration", "accepted")
