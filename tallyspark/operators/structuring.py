"""Generated JSON to typed cells: fields and rows validated against the registry, repaired, merged over pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import apply_rule, free_text, rate
from ..functions.unicode import strip, unicode_fold_all
from ..plans.registry import FIELDS, GROUP_FIELDS
from .recovering import backfill_single_rate, flat_fields

#: A free text that is no field of the record.
SUMMARY = "purpose_summary"
KEYS = [f[0] for f in FIELDS]
RULES = {f[0]: f[4] or f[3] for f in FIELDS}
GROUP_RULES = {g: {k: reader or kind for gg, k, _, kind, reader, _ in GROUP_FIELDS if gg == g} for g, *_ in GROUP_FIELDS}


def coerced(key: str, value: Column, nfc: bool = True) -> Column:
    """The canonical form of one value of ``key``; null where there is none or it cannot be read."""
    return free_text(value, nfc=nfc) if key == SUMMARY else apply_rule(F.lit(RULES[key]), value, nfc)


def read_cells(docs: DataFrame, texts: Column, keys: list[str], rules: dict[str, str], by: list[str], nfc: bool, more: Column | None = None) -> DataFrame:
    """Long table ``by, field_key, pred_raw, pred_norm`` of ``texts``, an array with one text for each of ``keys``.

    Each record is taken apart once and its texts are folded together; only those that are there are read.
    ``more``, an array of texts that belong to the record, comes clean with each cell as ``more``.
    """
    more = F.expr("CAST(array() AS array<string>)") if more is None else more
    held = docs.select(F.struct(*by).alias("by"), F.struct(texts.alias("texts"), more.alias("more")).alias("raw"))
    clean = F.transform(F.concat("raw.texts", "raw.more"), strip)
    held = held.withColumn("clean", clean)
    held = held.withColumn("clean", unicode_fold_all(F.col("clean"))) if nfc else held
    cells = F.array(*(F.struct(F.lit(k).alias("field_key"), F.lit(rules[k]).alias("rule"), F.get("raw.texts", F.lit(n)).alias("pred_raw"), F.get("clean", F.lit(n)).alias("text")) for n, k in enumerate(keys)))
    rest = F.slice("clean", F.lit(len(keys) + 1), F.size("raw.more"))
    long = held.select("by", rest.alias("more"), F.explode(cells).alias("c"))
    norm = F.when(F.col("c.text").isNotNull(), apply_rule(F.col("c.rule"), F.col("c.text"), nfc=False))
    return long.select(*(F.col("by")[c].alias(c) for c in by), "c.field_key", "c.pred_raw", norm.alias("pred_norm"), "more")


def field_texts(json: Column) -> Column:
    """The texts of all fields of the record, in the order of ``KEYS``."""
    return F.map_values(flat_fields(json, KEYS))


def fields(docs: DataFrame, json: str, by: list[str], nfc: bool = True) -> DataFrame:
    """Long table ``by, field_key, pred_raw, pred_norm`` of all fields of the record, in any case of letters.

    Text that is no object gives fields without a value.
    """
    return read_cells(docs, field_texts(F.col(json)), KEYS, RULES, by, nfc).drop("more")


def _member(json: Column, name: str) -> Column:
    """The member of an object by a name in any case of letters, as JSON text."""
    entries = F.map_entries(F.from_json(json, "map<string,variant>"))
    return F.to_json(F.try_element_at(F.filter(entries, lambda e: F.lower(e.key) == name), F.lit(-1)).value)


def _objects(json: Column, group: str) -> Column:
    """The members of the list ``group`` that are objects; null where there is no such list."""
    return F.filter(F.from_json(_member(json, group), "array<variant>"), lambda v: F.schema_of_variant(v).startswith("OBJECT"))


def rows(docs: DataFrame, json: str, by: list[str], group: str, nfc: bool = True) -> DataFrame:
    """Long table ``by, row_group, i, field_key, pred_raw, pred_norm`` of the rows of ``group``.

    What is no list has no rows, and members of a list that are no objects are none; cells that the group
    does not have go, those that a row lacks are null.
    """
    keys = list(GROUP_RULES[group])
    held = docs.select(F.struct(*by).alias("by"), F.posexplode(_objects(F.col(json), group)).alias("i", "row"))
    cells = read_cells(held, F.map_values(flat_fields(F.to_json("row"), keys)), keys, GROUP_RULES[group], ["by", "i"], nfc)
    return cells.select(*(F.col("by")[c].alias(c) for c in by), F.lit(group).alias("row_group"), "i", "field_key", "pred_raw", "pred_norm")


def parsed(docs: DataFrame, json: str, by: list[str], nfc: bool = True) -> DataFrame:
    """``fields``, where a missing flat rate is that of the record's own VAT rows if they agree on one."""
    rates = F.transform(_objects(F.col(json), "vat_breakdown"), lambda row: F.try_element_at(flat_fields(F.to_json(row), ["rate_percent"]), F.lit("rate_percent")))
    said = F.coalesce(rates, F.expr("CAST(array() AS array<string>)"))
    cells = read_cells(docs, field_texts(F.col(json)), KEYS, RULES, by, nfc, said)
    filled = backfill_single_rate(F.col("pred_norm"), F.transform("more", rate))
    return cells.select(*by, "field_key", "pred_raw", F.when(F.col("field_key") == "tax_rate", filled).otherwise(F.col("pred_norm")).alias("pred_norm"))


def parsed_pages(pages: DataFrame, json: str, by: list[str], page: str, nfc: bool = True) -> DataFrame:
    """The fields of a document whose pages were read one by one: the first page that has a value wins.

    Only cells with a value are brought together, beside one without for each field of each document.
    """
    cells = parsed(pages, json, [*by, page], nfc).filter("pred_norm IS NOT NULL").select(*by, page, "field_key", "pred_norm")
    none = pages.select(*by).distinct().select(*by, F.explode(F.array(*map(F.lit, KEYS))).alias("field_key"))
    every = cells.unionByName(none, allowMissingColumns=True)
    return every.groupBy(*by, "field_key").agg(F.min_by("pred_norm", F.when(F.col("pred_norm").isNotNull(), F.col(page))).alias("pred_norm"))


def kept_rows(cells: DataFrame, by: list[str]) -> DataFrame:
    """Cells of rows that hold a value; rows without any go, blanks count as none."""
    known = cells.withColumn("pred_norm", F.when(F.trim("pred_norm") != "", F.col("pred_norm")))
    some = known.groupBy(*by, "row_group", "i").agg(F.count("pred_norm").alias("n")).filter("n > 0").drop("n")
    return known.join(some, [*by, "row_group", "i"], "left_semi")
