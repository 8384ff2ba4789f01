"""Queries on pages, markup, merges and JSON in generated text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import recovering
from .catalog import query
from .inputs import duck, frame, table

_TURNS = "SELECT conv_id, turn, role, CASE WHEN (conv_id + turn) % 3 = 0 THEN CAST(NULL AS STRING) WHEN (conv_id + turn) % 7 = 0 THEN '' ELSE text END AS value, CAST((conv_id * 7 + turn * 3) % 5 AS DOUBLE) / 5 AS confidence FROM {conversations}"


@query("SELECT conv_id, count(*) AS n_pages, md5(string_agg(trim(text, chr(32) || chr(9) || chr(10) || chr(13)), chr(12) ORDER BY turn)) AS digest FROM conversations WHERE trim(text, chr(32) || chr(9) || chr(10) || chr(13)) <> '' GROUP BY 1")
def page_split(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    marked = F.concat(F.lit("===== PAGE "), F.col("turn").cast("string"), F.lit(" =====\n"), F.coalesce("text", F.lit("")))
    bodies = turns.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("turn", marked.alias("t")))).t, "\n").alias("body"))
    return bodies.select("conv_id", F.size(T.pages(F.col("body"))).cast("long").alias("n_pages"), F.md5(F.array_join(T.pages(F.col("body")), "\f")).alias("digest")).filter("n_pages > 0")


@query(f"SELECT conv_id, role, first(value ORDER BY turn) FILTER (value IS NOT NULL) AS value FROM ({duck(_TURNS)}) GROUP BY 1, 2")
def page_merge_first_nonnull(spark, sf_dir):
    return recovering.first_page_wins(frame(spark, sf_dir, _TURNS), ["conv_id", "role"], "turn", "value")


@query(f"SELECT conv_id, role, arg_max(value, confidence * 1000 - turn) FILTER (value IS NOT NULL) AS value FROM ({duck(_TURNS)}) GROUP BY 1, 2")
def channel_merge_confidence(spark, sf_dir):
    return recovering.confident_page_wins(frame(spark, sf_dir, _TURNS), ["conv_id", "role"], "turn", "value", "confidence")


@query("SELECT conv_id, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1")
def concat_merge(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    return recovering.joined_pages(turns, ["conv_id"], "turn", "text")


_ROWS = "SELECT o_custkey AS doc_id, o_orderkey AS page, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 4 END AS n FROM {orders}"


@query(f"SELECT doc_id, coalesce(first(n ORDER BY page) FILTER (n > 0), 0) AS first_rows, CAST(sum(n) AS BIGINT) AS all_rows FROM ({duck(_ROWS)}) GROUP BY 1")
def group_merges(spark, sf_dir):
    pages = frame(spark, sf_dir, _ROWS).withColumn("rows", F.array_repeat("page", F.col("n").cast("int")))
    first = recovering.first_rows_win(pages, ["doc_id"], "page", "rows").select("doc_id", F.greatest(F.coalesce(F.size("rows"), F.lit(0)), F.lit(0)).cast("long").alias("first_rows"))
    return first.join(recovering.all_rows(pages, ["doc_id"], "page", "rows").select("doc_id", F.size("rows").cast("long").alias("all_rows")), "doc_id")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_flat_extract(spark, sf_dir):
    fields = recovering.flat_fields(F.col("props"), ["k", "missing"])
    return table(spark, sf_dir, "events").select("event_id", fields["k"].alias("k"))




@query("SELECT event_id, CASE WHEN event_id % 7 IN (0, 1, 2, 3) THEN json_extract_string(props, '$.k') WHEN event_id % 7 = 5 THEN CAST(event_id AS VARCHAR) END AS k FROM events")
def json_recovery(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    k, line = F.col("event_id") % 7, F.lit("\n")
    props = F.col("props")
    said = (
        F.when(k == 0, props)
        .when(k == 1, F.concat(F.lit("Here: "), props, F.lit(' and {"x": 1}')))
        .when(k == 2, F.concat(F.lit("```json"), line, props, line, F.lit("```")))
        .when(k == 3, F.regexp_replace(props, "}", ",}"))
        .when(k == 4, F.concat(F.lit("["), props, F.lit("]")))
        .when(k == 5, F.concat(F.lit('{"r": [{"e": "}"}, {"k": '), F.col("event_id").cast("string"), F.lit("} }")))
        .otherwise(F.lit('{"k": [1, 2'))
    )
    found = recovering.recovered(said)
    return events.select("event_id", F.coalesce(F.get_json_object(found, "$.k"), F.get_json_object(found, "$.r[1].k")).alias("k"))


@query(f"SELECT page_id, md5(regexp_replace(html, '<(/?({'|'.join(T.MARKUP)})|loc_[0-9]+)>', '', 'g')) AS digest FROM pages WHERE html IS NOT NULL")
def markup_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").filter("html IS NOT NULL").select("page_id", F.md5(T.strip_markup(F.col("html"))).alias("digest"))


_RUNS = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE text IS NOT NULL),
f AS (SELECT *, CASE WHEN line = lag(line) OVER (PARTITION BY doc_id ORDER BY n) THEN 0 ELSE 1 END AS new FROM l),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY n) AS run FROM f),
r AS (SELECT *, count(*) OVER (PARTITION BY doc_id, run) AS alike, row_number() OVER (PARTITION BY doc_id, run ORDER BY n) AS k FROM g)
SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY n)) AS digest FROM r WHERE alike < 3 OR k = 1 GROUP BY 1"""


@query(_RUNS)
def line_run_collapse(spark, sf_dir):
    collapsed = T.collapse_line_runs(F.col("text"))
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.md5(collapsed).alias("digest"))


@query("SELECT doc_id, md5(regexp_replace(regexp_replace(text, '<\\|(im_end|im_start|endoftext|end|user|assistant|system)\\|>|<eos>|<bos>', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')) AS digest FROM documents WHERE text IS NOT NULL")
def blank_line_and_chat_token_strip(spark, sf_dir):
    cleaned = T.collapse_blank_lines(T.strip_chat_tokens(F.col("text")))
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.md5(cleaned).alias("digest"))


_LABELLED = "SELECT o_orderkey AS doc_id, concat('Rechnung', chr(10), '**Rechnungsnummer**: RE-', CAST(o_orderkey AS STRING), chr(10), '* Kundennummer ', CASE WHEN o_orderkey % 3 = 0 THEN '[ID fehlt]' ELSE CAST(o_custkey AS STRING) END, '.', chr(10), 'Belegsummen', chr(10), 'Summe: ', CAST(o_orderkey % 900 AS STRING), ',50 EUR', chr(10), 'Bruttobetrag', chr(10), '1.', lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0'), ',25', chr(10), 'Zahlungsbedingung: 7 Tage 9,99') AS page, o_custkey, o_orderkey FROM {orders}"


@query(f"SELECT doc_id, concat('RE-', CAST(o_orderkey AS VARCHAR)) AS number, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS customer, concat(CAST(o_orderkey % 900 AS VARCHAR), ',50') AS net, concat('1.', lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0'), ',25') AS gross FROM ({duck(_LABELLED)})")
def label_extract_and_totals(spark, sf_dir):
    page = F.col("page")
    window = T.totals_window(page)
    return frame(spark, sf_dir, _LABELLED).select(
        "doc_id", T.labelled(page, "Rechnungsnummer").alias("number"), T.labelled(page, "Kundennummer").alias("customer"), T.amount_after(window, "Summe").alias("net"), T.amount_after(window, "Bruttobetrag").alias("gross")
    )


@query("SELECT doc_id, CAST(ceil(n_chars / 28.0) * ceil(900 / 28.0) AS BIGINT) AS tokens FROM documents")
def image_tokens(spark, sf_dir):
    from ..functions.similarity import image_tokens as count

    return table(spark, sf_dir, "documents").select("doc_id", count(F.lit(900), F.col("n_chars")).alias("tokens"))


_TILES = """WITH d AS (SELECT doc_id, CAST(n_chars AS BIGINT) AS h FROM documents WHERE n_chars IS NOT NULL),
t AS (SELECT doc_id, h, CASE WHEN h <= 1800 THEN 1 ELSE 1 + greatest(0, CAST(ceil((h - 1170) / 1029.0) AS BIGINT)) END AS n FROM d),
e AS (SELECT doc_id, h, CAST(unnest(range(n)) AS INTEGER) AS tile FROM t)
SELECT doc_id, tile, CAST(0 AS BIGINT) AS x0, CASE WHEN h <= 1800 THEN 0 ELSE least(tile * 1029, h - 1170) END AS y0, CAST(900 AS BIGINT) AS x1,
       CASE WHEN h <= 1800 THEN h ELSE least(least(tile * 1029, h - 1170) + 1170, h) END AS y1 FROM e"""


@query(_TILES)
def tile_plan(spark, sf_dir):
    from ..functions.similarity import tile_plan as plan

    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(plan(F.lit(900), F.col("n_chars")))).select("doc_id", F.col("pos").alias("tile"), "col.*")


@query("SELECT doc_id, CAST((contains(lower(text), ' the '))::INT + (contains(lower(text), ' der '))::INT + (contains(lower(text), ' la '))::INT AS BIGINT) AS hits FROM documents WHERE text IS NOT NULL")
def language_hits(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", T.language_hits(F.col("text"), [" the ", " der ", " la "]).alias("hits"))
