"""Transcripts of readers: text files of a header and page blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.unicode import nullif_empty

#: Columns of a batch or stream of whole text files.
RAW = "value string"


def parse(raw: DataFrame) -> DataFrame:
    """``model_id, invoice, body, pages, error`` of whole files in ``value``; a malformed one has its error and no body."""
    head = F.regexp_extract("value", r"(?s)^(.*?)\n\s*\n", 1)
    model, invoice = T.header(head, "Model"), T.header(head, "Invoice")
    body = F.when(model.isNotNull() & invoice.isNotNull(), F.regexp_extract("value", r"(?s)^.*?\n\s*\n(.*)$", 1))
    error = F.when(model.isNull(), "no model").when(invoice.isNull(), "no invoice")
    return raw.select(model.alias("model_id"), invoice.alias("invoice"), body.alias("body"), error.alias("error")).withColumn("pages", T.pages(F.col("body")))


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path, wholetext=True))


def smoke_body(text: str = "value"):
    """The body that a smoke run prints between its banner and a rule; empty if there is none."""
    return F.regexp_extract(text, r"(?s)Output snippet \(first \d+ chars\):\s*\n(.*?)\n-{5,}", 1)


def render(df: DataFrame) -> DataFrame:
    """Transcript files' text from ``model_id, invoice, pages``."""
    blocks = F.transform("pages", lambda p, i: F.concat(F.lit("===== PAGE "), (i + 1).cast("string"), F.lit(" =====\n"), p))
    head = F.concat(F.lit("# Model: "), "model_id", F.lit("\n# Invoice: "), "invoice", F.lit("\n\n"))
    return df.select(F.concat(head, F.array_join(blocks, "\n")).alias("value"))


def last_transcript(df: DataFrame, path: str) -> DataFrame:
    """Of several transcripts of one model and invoice, the last by path."""
    rest = [c for c in df.columns if c not in ("model_id", "invoice")]
    return df.groupBy("model_id", "invoice").agg(F.max_by(F.struct(*rest), path).alias("r")).select("model_id", "invoice", "r.*")


def record_text(pages: str = "pages"):
    return nullif_empty(F.array_join(pages, "\n\n"))
