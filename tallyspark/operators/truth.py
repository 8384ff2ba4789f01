"""Stored records from written JSON, from free text of payment terms, and what is stored about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import gold_rate
from ..functions.unicode import strip
from . import structuring

#: Fields whose answer is left out of the score where no channel could find it on the page.
NEUTRAL = ["payment_means_text"]
#: What a warrant says of such an answer.
UNLOCATED = "null-disputed"


def from_json(docs: DataFrame, json: str, id_col: str, nfc: bool = True) -> DataFrame:
    """``id, field_key, gt_present, gt_raw, gt_norm`` of every field of a record written as JSON.

    The fields stand in ``fields`` or at the top. Blank and null values are absent; what cannot be read is
    present and null; so is an answer of a neutral field that the warrants call unlocated.
    """
    whole = F.col(json)
    inner = F.coalesce(F.get_json_object(whole, "$.fields"), whole)
    written = F.transform(structuring.field_texts(inner), lambda raw: F.when(strip(raw) != "", raw))
    unlocated = lambda key: F.coalesce(F.get_json_object(whole, f"$.provenance.{key}.escalated_as") == UNLOCATED, F.lit(False))
    neutral = F.array_compact(F.array(*(F.when(unlocated(key), F.lit(key)) for key in NEUTRAL)))
    held = docs.select(F.struct(F.col(id_col).alias("id"), neutral.alias("neutral")).alias("of"), written.alias("texts"))
    cells = structuring.read_cells(held, F.col("texts"), structuring.KEYS, structuring.RULES, ["of"], nfc)
    norm = F.when(~F.array_contains("of.neutral", F.col("field_key")), F.col("pred_norm"))
    return cells.select(F.col("of.id").alias(id_col), "field_key", F.col("pred_raw").isNotNull().alias("gt_present"), F.col("pred_raw").alias("gt_raw"), norm.alias("gt_norm"))


def rows_from_json(docs: DataFrame, json: str, id_col: str, group: str, nfc: bool = True) -> DataFrame:
    """Cells of the rows of ``group`` as stored ones: ``id, row_group, j, field_key, gt_present, gt_norm``."""
    cells = structuring.rows(docs, json, [id_col], group, nfc).withColumnRenamed("i", "j")
    present = F.coalesce(strip(F.col("pred_raw")) != "", F.lit(False))
    return cells.select(id_col, "row_group", "j", "field_key", present.alias("gt_present"), F.when(present, F.col("pred_norm")).alias("gt_norm"))


def verified(index: DataFrame, records: DataFrame, id_col: str, only_verified: bool = True) -> DataFrame:
    """Records of the items of an index, of those marked as verified alone if asked."""
    return records.join(index.filter("verified") if only_verified else index, id_col, "left_semi")


def net_due_date(descriptions: Column) -> Column:
    """The day by which terms say that the net amount is due, of the first description that says so; null if it is no day."""
    said = F.filter(F.transform(descriptions, lambda d: F.regexp_extract_all(d, F.lit(r"(?i)\bnetto\s+bis\s+([0-9]{1,2}[.][0-9]{1,2}[.][0-9]{4})"), F.lit(1))), lambda days: F.size(days) > 0)
    return F.try_to_date(F.try_element_at(F.flatten(said), F.lit(1)), "d.M.yyyy").cast("string")


def discount_tiers(descriptions: Column) -> Column:
    """``percent`` and ``days`` of each discount that the terms offer, in order."""
    offer = r"(?i)[0-9]+(?:[.,][0-9]+)?\s*%\s*skonto\s+innerhalb\s+[0-9]+\s*tagen"
    found = F.flatten(F.transform(descriptions, lambda d: F.regexp_extract_all(d, F.lit(offer), F.lit(0))))
    percent = lambda t: gold_rate(F.translate(F.regexp_extract(t, "^[0-9.,]+", 0), ",", "."))
    return F.transform(found, lambda t: F.struct(percent(t).alias("percent"), F.regexp_extract(t, r"([0-9]+)\s*\D+$", 1).alias("days")))


def descriptions(texts: Column) -> Column:
    """Trimmed descriptions, empty ones left out."""
    return F.filter(F.transform(texts, strip), lambda t: t != "")


def with_free_terms(cells: DataFrame, due: DataFrame, id_col: str) -> DataFrame:
    """Stored cells where an absent due date is that of the free text, ``due(id, due)``."""
    fill = ~F.col("gt_present") & (F.col("field_key") == "payment_due_date") & F.col("due").isNotNull()
    joined = cells.join(due, id_col, "left")
    return joined.select(id_col, "field_key", (F.col("gt_present") | fill).alias("gt_present"), F.when(fill, F.col("due")).otherwise(F.col("gt_norm")).alias("gt_norm"))
