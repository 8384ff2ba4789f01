"""Stored records from invoices in cross-industry XML, of either schema version, by built-in XPath."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize
from ..functions.unicode import nullif_empty, strip
from ..plans.registry import ADDRESS_PARTS, FIELDS, GROUP_FIELDS, GROUP_ROWS, OLDER_NAMES, OPTIONAL_TOTALS

READERS = {"DATE": normalize.gold_date, "MONEY": normalize.gold_money, "RATE": normalize.gold_rate}


def xpath(path: str, older: bool = False, root: bool = True) -> str:
    """An element path by local names, since Spark's XPath knows no namespaces; attribute tests stay."""
    steps = []
    for step in path.split("/"):
        name, test = re.fullmatch(r"([^\[]+)(\[.*\])?", step).groups()
        steps.append(f'*[local-name()="{OLDER_NAMES.get(name, name) if older else name}"]{(test or "").replace(chr(39), chr(34))}')
    return ("/" if root else "") + "/".join(steps)


def _texts(xml: Column, path: str) -> Column:
    return F.xpath(xml, F.lit(path + "/text()"))


def _by_version(xml: Column, path: str, read) -> Column:
    old = F.xpath_boolean(xml, F.lit(f'/*[local-name()="{OLDER_NAMES["CrossIndustryInvoice"]}"]'))
    return F.when(old, read(xpath(path, older=True))).otherwise(read(xpath(path)))


def _gold(key: str, kind: str, reader: str, raw: Column) -> Column:
    if key == "document_type":
        return normalize.document_type(raw)
    if reader == "unsigned_money":
        return normalize.gold_unsigned_money(raw)
    return READERS.get(kind, lambda c: normalize.gold_text(c, nfc=True))(raw)


def parse(df: DataFrame, xml_col: str = "xml", id_col: str = "doc_id") -> DataFrame:
    """The long table of stored cells: ``doc_id, field_key, gt_present, gt_raw, gt_norm``, absent ones too.

    An element without text is present and empty; a value that cannot be read is present and null. Several
    rates on one invoice, or a rate of zero, leave the flat rate rejected; an optional total of zero is
    absent. The first of several elements counts. Text that is no invoice XML gives absent cells.
    """
    xml = F.col(xml_col)
    cells = []
    for key, _, _, kind, reader, _, path in FIELDS:
        present = _by_version(xml, path, lambda p: F.xpath_boolean(xml, F.lit(p)))
        raw = strip(_by_version(xml, path, lambda p: F.xpath_string(xml, F.lit(p))))
        if key.endswith("_address"):
            raw = F.concat_ws(", ", *(nullif_empty(strip(_by_version(xml, f"{path}/{part}", lambda p: F.xpath_string(xml, F.lit(p))))) for part in ADDRESS_PARTS))
        norm = F.when(raw == "", "").otherwise(_gold(key, kind, reader, raw))
        if key == "tax_rate":
            rates = F.array_distinct(F.transform(_by_version(xml, path, lambda p: _texts(xml, p)), normalize.gold_rate))
            norm = F.when((F.size(rates) > 1) | (norm == "0"), None).otherwise(norm)
        if key in OPTIONAL_TOTALS:
            present = present & ~F.coalesce(norm.isin("0.00", "-0.00"), F.lit(False))
        cells.append(F.struct(F.lit(key).alias("field_key"), F.coalesce(present, F.lit(False)).alias("gt_present"), F.when(present, raw).alias("gt_raw"), F.when(present, norm).alias("gt_norm")))
    return df.select(id_col, F.explode(F.array(*cells)).alias("c")).select(id_col, "c.*")


def row_fragments(xml: Column, name: str) -> Column:
    """The elements of local name ``name``, in document order, each as a document with the root's name spaces."""
    open_, close = rf"<(?:[\w.-]+:)?{name}(?=[\s/>])", rf"</(?:[\w.-]+:)?{name}\s*>"
    found = F.regexp_extract_all(xml, F.lit(rf"(?s)({open_}[^>]*/>|{open_}.*?{close})"), F.lit(1))
    spaces = F.array_join(F.array_distinct(F.regexp_extract_all(xml, F.lit(r"""(xmlns(?::[\w.-]+)?\s*=\s*(?:"[^"]*"|'[^']*'))"""), F.lit(1))), " ")
    return F.transform(found, lambda row: F.concat(F.lit("<row "), spaces, F.lit(">"), row, F.lit("</row>")))


def parse_rows(df: DataFrame, group: str, xml_col: str = "xml", id_col: str = "doc_id") -> DataFrame:
    """Cells of the rows of ``group``: ``doc_id, row_group, j, field_key, gt_present, gt_norm``, absent ones too.

    A row that leaves a cell out has it as absent; an element without text is present and empty. The first
    of several elements counts. ``j`` counts the rows from 0; an invoice without rows has none.
    """
    xml, path = F.col(xml_col), GROUP_ROWS[group]
    name = re.sub(r"\[.*", "", path.rsplit("/", 1)[-1])
    old = F.xpath_boolean(xml, F.lit(f'/*[local-name()="{OLDER_NAMES["CrossIndustryInvoice"]}"]'))
    fragments = F.when(old, row_fragments(xml, OLDER_NAMES.get(name, name))).otherwise(row_fragments(xml, name))
    rows = df.select(id_col, old.alias("old"), F.posexplode(fragments).alias("j", "row"))
    cells = []
    for g, key, _, kind, reader, path in GROUP_FIELDS:
        if g != group:
            continue
        at = lambda read: F.when(F.col("old"), read("/row/*/" + xpath(path, older=True, root=False))).otherwise(read("/row/*/" + xpath(path, root=False)))  # noqa: B023, E731
        present = at(lambda p: F.xpath_boolean("row", F.lit(p)))
        raw = strip(at(lambda p: F.xpath_string("row", F.lit(p))))
        norm = F.when(present, F.when(raw == "", "").otherwise(_gold(key, kind, reader, raw)))
        cells.append(F.struct(F.lit(key).alias("field_key"), present.alias("gt_present"), norm.alias("gt_norm")))
    long = rows.select(id_col, F.lit(group).alias("row_group"), "j", F.explode(F.array(*cells)).alias("c"))
    return long.select(id_col, "row_group", "j", "c.*")
