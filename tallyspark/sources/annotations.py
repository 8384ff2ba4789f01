"""Public annotation sets as feature tables: tagged tokens, receipts, forms, invoice fields, page layouts, answers.

Each reader is a projection over Spark's own Parquet and JSON readers; image bytes are read only by readers
that are asked for them, since nested columns are pruned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.unicode import nullif_empty, strip

_TEMPLATE = r"(?i)^Template(\d+)_Instance(\d+)\.jpg$"


def parquet_index(spark: SparkSession, path: str) -> DataFrame:
    """Rows of each Parquet file, and its split by the name's first part."""
    rows = spark.read.parquet(path).select(F.col("_metadata.file_name").alias("file")).groupBy("file").agg(F.count("*").alias("n_rows"))
    return rows.withColumn("split", F.regexp_extract("file", r"^([A-Za-z]+)", 1))


def tagged_tokens(df: DataFrame, image_bytes: bool = False) -> DataFrame:
    """Features of ``id, image, tokens, ner_tags, bboxes`` rows."""
    part = lambda k: nullif_empty(F.regexp_extract("image.path", _TEMPLATE, k))
    return df.select(
        "id", part(1).alias("template_id"), part(2).try_cast("int").alias("instance_id"), F.size("tokens").alias("n_tokens"),
        F.array_sort(F.array_distinct("ner_tags")).alias("tags"), F.size("bboxes").alias("n_bboxes"),
        *([F.octet_length("image.bytes").alias("n_bytes"), F.col("image.bytes").alias("bytes")] if image_bytes else []),
    )


def receipts(df: DataFrame) -> DataFrame:
    """Features of receipts' ``ground_truth`` JSON: keys, menu items (a lone item counts one), the total if it is text."""
    v = F.try_parse_json("ground_truth")
    parsed = df.withColumn("__v", v)
    kind = lambda p: F.schema_of_variant(F.try_variant_get("__v", p, "variant"))
    menu, total = kind("$.gt_parse.menu"), kind("$.gt_parse.total.total_price")
    items = F.size(F.try_variant_get("__v", "$.gt_parse.menu", "array<variant>"))
    return parsed.select(
        *(c for c in df.columns if c not in ("ground_truth", "image")),
        F.array_sort(F.map_keys(F.try_variant_get("__v", "$.gt_parse", "map<string,variant>"))).alias("keys"),
        F.when(menu.startswith("ARRAY"), items).when(menu.startswith("OBJECT"), 1).otherwise(0).alias("n_items"),
        F.when(total == "STRING", F.try_variant_get("__v", "$.gt_parse.total.total_price", "string")).alias("total_price"),
        F.col("__v").isNull().alias("malformed"),
    )


def forms(df: DataFrame, id_col: str = "stem") -> DataFrame:
    """Entities, words, links and labels of ``form`` arrays (box, text, label, words, linking, id)."""
    count = lambda label: F.size(F.filter("form", lambda e: e.label == label)).alias(f"n_{label}")
    total = lambda get: F.aggregate(F.transform("form", get), F.lit(0), lambda a, n: a + n)
    labels = F.array_distinct(F.transform("form", lambda e: e.label))
    counter = F.map_from_arrays(labels, F.transform(labels, lambda k: F.size(F.filter("form", lambda e: e.label == k))))
    return df.select(id_col, F.size("form").alias("n_entities"), total(lambda e: F.size(e.words)).alias("n_words"), total(lambda e: F.size(e.linking)).alias("n_links"), counter.alias("labels"), *map(count, ("question", "answer", "header", "other")))


def label_totals(df: DataFrame, labels: str = "labels") -> DataFrame:
    """Counts of all rows' label counters together."""
    return df.select(F.explode(labels).alias("label", "n")).groupBy("label").agg(F.sum("n").cast("long").alias("n")).orderBy(F.desc("n"), "label")


def image_dims(text: Column) -> Column:
    """``[w, h, c]`` as an array of three integers, or null."""
    numbers = F.from_json(text, "array<int>")
    return F.when((F.size(numbers) == 3) & ~F.exists(numbers, lambda n: n.isNull()), numbers)


def invoice_fields(df: DataFrame, documented: dict[str, str], id_col: str = "stem") -> DataFrame:
    """Fields of annotated invoices with their label as documented; null where the label is unknown."""
    known = F.create_map(*(F.lit(x) for pair in documented.items() for x in pair))
    rows = df.select(id_col, image_dims(F.col("image_dims")).alias("dims"), F.posexplode_outer("Fields").alias("n", "f"))
    return rows.select(id_col, "dims", "n", F.col("f.key.tag").alias("key_tag"), F.col("f.value.label").alias("label"), known[F.col("f.value.label")].alias("documented"))


def page_layouts(df: DataFrame) -> DataFrame:
    """Attributes and region categories of annotated pages."""
    a = "page_info.page_attribute"
    return df.select(
        F.col("page_info.image_path").alias("image_path"), F.col("page_info.page_no").alias("page_no"), F.col("page_info.width").alias("width"), F.col("page_info.height").alias("height"),
        *(F.col(f"{a}.{k}").alias(k) for k in ("language", "data_source", "layout")), F.col(f"{a}.special_issue").alias("special_issues"),
        F.array_sort(F.array_distinct(F.transform("layout_dets", lambda d: d.category_type))).alias("categories"),
    )


def category_counts(layouts: DataFrame) -> DataFrame:
    """Pages that hold each category."""
    return layouts.select(F.explode("categories").alias("category")).groupBy("category").agg(F.count("*").alias("n_pages")).orderBy(F.desc("n_pages"), "category")


def answer_sections(answer: Column) -> Column:
    """``(key): value`` sections and a trailing ``Sources: [..]`` as a map; of equal keys the last counts."""
    pattern = r"(?s)\(([^()\n]+)\):\s*(.*?)(?=\n\s*\([^()\n]+\):|\n?\s*Sources:|\z)"
    keys = F.transform(F.regexp_extract_all(answer, F.lit(pattern), F.lit(1)), strip)
    values = F.transform(F.regexp_extract_all(answer, F.lit(pattern), F.lit(2)), strip)
    sources = nullif_empty(F.regexp_extract(answer, r"(?s)Sources:\s*(\[.*?\])", 1))
    pairs = F.transform(keys, lambda k, i: F.struct(k.alias("k"), F.get(values, i).alias("v"), i.alias("i")))
    last = F.filter(pairs, lambda p: ~F.exists(pairs, lambda q: (q.k == p.k) & (q.i > p.i)))
    found = F.map_from_entries(F.transform(last, lambda p: F.struct(p.k, p.v)))
    return F.when(sources.isNotNull(), F.map_concat(found, F.create_map(F.lit("Sources"), sources))).otherwise(found)


def prompt_answers(df: DataFrame) -> DataFrame:
    """Lengths, sections and main answer of prompts with answers."""
    sections = answer_sections(F.col("TRUTH_answer"))
    return df.select(
        "source_identifier", "template_id", "element_identifier", F.length("FEATURE_full_prompt").alias("n_prompt"), F.length("TRUTH_answer").alias("n_answer"), F.size(sections).alias("n_sections"), sections.getItem("main question").alias("main_answer")
    )
