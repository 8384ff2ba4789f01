"""Queries on written records, generated JSON, readers' texts, runs and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import similarity
from ..functions import text as T
from ..operators import running, scoring, structuring, truth
from .catalog import query
from .inputs import CELLS, COUNTS_SQL, duck, f1_sql, frame, judged, ratio_sql, scored_sql, spread, table

_FIELDS = """concat('<"Invoice_Number": "Rechnung Nr. RE-', CAST(o_orderkey AS STRING), '", "issue_date": "', concat(substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 9, 2), '.', substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 6, 2), '.', substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 4)), '", "grand_total_amount": "', CAST(o_custkey AS STRING), ',50 EUR", "seller_name": " ", "tax_rate": ',
  CASE WHEN o_orderkey % 5 = 0 THEN 'null' ELSE CAST(o_orderkey % 20 AS STRING) END, ', "buyer_name": ["x"], "payment_means_text": ', CASE WHEN o_orderkey % 4 = 0 THEN 'null' ELSE concat('"Firma ', CAST(o_custkey AS STRING), '"') END, ',
  "VAT_breakdown": [<"rate_percent": "', CAST(o_orderkey % 3 AS STRING), ',50 %", "Tax_Amount": ', CAST(o_custkey AS STRING), '>, "no row", <"rate_percent": "', CAST(o_orderkey % 2 AS STRING), ',5", "category_code": "s">]>')"""
#: Braces are written as angles first, since a brace names a table in shared SQL.
_BRACED = "replace(replace({0}, '<', chr(123)), '>', chr(125))"
_WHOLE = f"CASE o_orderkey % 3 WHEN 0 THEN {_FIELDS} WHEN 1 THEN concat('<\"schema_version\": 2, \"fields\": ', {_FIELDS}, '>') ELSE concat('<\"fields\": ', {_FIELDS}, ', \"provenance\": <\"payment_means_text\": <\"escalated_as\": \"null-disputed\">>>') END"
_JSON = f"SELECT o_orderkey AS doc_id, o_custkey AS customer, o_orderkey % 5 = 0 AS no_rate, {_BRACED.format(_WHOLE)} AS json, {_BRACED.format(_FIELDS)} AS fields, CAST(CAST(o_orderdate AS DATE) AS STRING) AS day FROM {{orders}}"

_FLAT = """SELECT doc_id, 'invoice_number' AS field_key, concat('RE-', CAST(doc_id AS VARCHAR)) AS value FROM j
UNION ALL SELECT doc_id, 'issue_date', day FROM j
UNION ALL SELECT doc_id, 'grand_total_amount', concat(CAST(customer AS VARCHAR), '.50') FROM j
UNION ALL SELECT doc_id, 'payment_means_text', concat('Firma ', CAST(customer AS VARCHAR)) FROM j WHERE doc_id % 4 <> 0"""


@query(f"WITH j AS ({duck(_JSON)}), f AS ({_FLAT} UNION ALL SELECT doc_id, 'tax_rate', CAST(doc_id % 20 AS VARCHAR) FROM j WHERE NOT no_rate) SELECT doc_id, field_key, true AS gt_present, CASE WHEN field_key <> 'payment_means_text' OR doc_id % 3 <> 2 THEN value END AS gt_norm FROM f")
def truth_from_json(spark, sf_dir):
    cells = truth.from_json(spread(spark, sf_dir, _JSON), "json", "doc_id")
    return cells.filter("gt_present").select("doc_id", "field_key", "gt_present", "gt_norm")


_TRUTH_ROWS = """SELECT doc_id, 0 AS j, 'rate_percent' AS field_key, concat(CAST(doc_id % 3 AS VARCHAR), '.5') AS gt_norm FROM j
UNION ALL SELECT doc_id, 0, 'tax_amount', concat(CAST(customer AS VARCHAR), '.00') FROM j
UNION ALL SELECT doc_id, 1, 'rate_percent', concat(CAST(doc_id % 2 AS VARCHAR), '.5') FROM j
UNION ALL SELECT doc_id, 1, 'category_code', 'S' FROM j"""


@query(f"WITH j AS ({duck(_JSON)}) {_TRUTH_ROWS}")
def truth_rows_from_json(spark, sf_dir):
    cells = truth.rows_from_json(spread(spark, sf_dir, _JSON), "fields", "doc_id", "vat_breakdown")
    return cells.filter("gt_present").select("doc_id", "j", "field_key", "gt_norm")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def heldout_verified_records(spark, sf_dir):
    index = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("verified"))
    return truth.verified(index, table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")


@query("SELECT count(*) FILTER (quality = 1) AS n_verified, count(*) AS n_total FROM labels")
def verification_progress(spark, sf_dir):
    return table(spark, sf_dir, "labels").agg(F.count_if(F.col("quality") == 1).alias("n_verified"), F.count("*").alias("n_total"))


_RATE = "CASE WHEN doc_id % 5 <> 0 THEN CAST(doc_id % 20 AS VARCHAR) WHEN doc_id % 3 = doc_id % 2 THEN concat(CAST(doc_id % 3 AS VARCHAR), '.5') END"


@query(f"WITH j AS ({duck(_JSON)}), f AS ({_FLAT} UNION ALL SELECT doc_id, 'tax_rate', {_RATE} FROM j) SELECT doc_id, field_key, value AS pred_norm FROM f WHERE value IS NOT NULL")
def structurer_parse(spark, sf_dir):
    from ..operators.recovering import recovered

    said = spread(spark, sf_dir, _JSON).select("doc_id", recovered(F.concat(F.lit("Sure:\n```json\n"), "fields", F.lit("\n```<eos>"))).alias("json"))
    return structuring.parsed(said, "json", ["doc_id"]).filter("pred_norm IS NOT NULL").select("doc_id", "field_key", "pred_norm")


@query(f"WITH j AS ({duck(_JSON)}) SELECT doc_id, 'vat_breakdown' AS row_group, j AS i, field_key, gt_norm AS pred_norm FROM ({_TRUTH_ROWS})")
def structurer_groups(spark, sf_dir):
    cells = structuring.rows(spread(spark, sf_dir, _JSON), "fields", ["doc_id"], "vat_breakdown")
    return structuring.kept_rows(cells, ["doc_id"]).filter("pred_norm IS NOT NULL").select("doc_id", "row_group", "i", "field_key", "pred_norm")


@query(f"WITH j AS ({duck(_JSON)}) SELECT customer, concat('RE-', CAST(min(doc_id) AS VARCHAR)) AS invoice_number, arg_min(rate, doc_id) AS tax_rate FROM (SELECT customer, doc_id, {_RATE} AS rate FROM j) GROUP BY 1")
def structurer_pages_merge(spark, sf_dir):
    merged = structuring.parsed_pages(spread(spark, sf_dir, _JSON), "fields", ["customer"], "doc_id").filter(F.col("field_key").isin("invoice_number", "tax_rate"))
    return merged.groupBy("customer").agg(F.max(F.when(F.col("field_key") == "invoice_number", F.col("pred_norm"))).alias("invoice_number"), F.max(F.when(F.col("field_key") == "tax_rate", F.col("pred_norm"))).alias("tax_rate"))


_BLOCKS = "SELECT o_orderkey AS doc_id, concat('head', chr(10), repeat(concat('a', chr(10), 'b', CAST(o_orderkey AS STRING), chr(10), 'c', chr(10)), CAST(o_orderkey % 5 AS INT)), 'tail') AS page FROM {orders}"


@query("SELECT o_orderkey AS doc_id, concat('head', chr(10), repeat(concat('a', chr(10), 'b', CAST(o_orderkey AS VARCHAR), chr(10), 'c', chr(10)), CASE WHEN o_orderkey % 5 >= 3 THEN 1 ELSE CAST(o_orderkey % 5 AS INTEGER) END), 'tail') AS page FROM orders")
def repeated_blocks(spark, sf_dir):
    return frame(spark, sf_dir, _BLOCKS).select("doc_id", T.collapse_blocks(F.col("page")).alias("page"))


_READERS = """SELECT o_orderkey AS doc_id, CASE o_orderkey % 4 WHEN 0 THEN 'x/granite-docling-1' WHEN 1 THEN 'MinerU2' WHEN 2 THEN 'paligemma-3b' ELSE 'other' END AS model,
  concat('<text><loc_5>Summe:<fcel>', CAST(o_custkey AS STRING), '<nl>x', chr(10), chr(10), chr(10), chr(10), 'y<|im_end|>') AS page, CAST(o_custkey AS STRING) AS c FROM {orders}"""


@query(f"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN concat('Summe:<fcel>', c, '<nl>x', chr(10), chr(10), 'y')
  WHEN 1 THEN concat('<text><loc_5>Summe: ', c, chr(10), 'x', chr(10), chr(10), 'y') ELSE concat('<text><loc_5>Summe:<fcel>', c, '<nl>x', chr(10), chr(10), 'y') END AS page FROM ({duck(_READERS)})""")
def reader_dispatch(spark, sf_dir):
    return frame(spark, sf_dir, _READERS).select("doc_id", T.adapted(F.col("page"), F.col("model")).alias("page"))


_SECTIONS = """SELECT o_orderkey AS doc_id, concat('## Käufer', chr(10), 'Name: Firma ', CAST(o_custkey AS STRING), chr(10), chr(10), 'Name: other', chr(10), 'Lieferschein Nr. L-', CAST(o_orderkey AS STRING), ' vom 03.04.2024', chr(10),
  'Belegsummen', chr(10), CASE WHEN o_orderkey % 2 = 0 THEN 'Gesamt' ELSE 'Brutto' END, ' ', CAST(o_custkey % 900 AS STRING), ',50', chr(10), 'Zahlungsbedingung') AS page, o_custkey AS customer FROM {orders}"""


@query(f"SELECT doc_id, concat('Firma ', CAST(customer AS VARCHAR)) AS buyer, concat('L-', CAST(doc_id AS VARCHAR)) AS number, '03.04.2024' AS day, concat(CAST(customer % 900 AS VARCHAR), ',50') AS total, CAST(2 AS BIGINT) AS n_lines FROM ({duck(_SECTIONS)})")
def sections_and_references(spark, sf_dir):
    page = F.col("page")
    number, day = T.cross_references(page)
    window = T.totals_window(page)
    return frame(spark, sf_dir, _SECTIONS).select(
        "doc_id", T.named_in_section(page, "Käufer").alias("buyer"), number.alias("number"), day.alias("day"), T.first_amount_of(window, ["Brutto", "Gesamt"]).alias("total"), F.size(T.window_lines(window)).cast("long").alias("n_lines")
    )


_TERMS = """SELECT o_orderkey AS doc_id, concat(' ', CAST(o_orderkey % 9 AS STRING), ',50 % Skonto innerhalb ', CAST(o_orderkey % 30 AS STRING), ' Tagen, 1% skonto innerhalb 40 Tagen') AS a,
  concat('Zahlbar netto bis ', CAST(1 + o_orderkey % 31 AS STRING), '.2.2024') AS b, 1 + o_orderkey % 31 AS d FROM {orders}"""


@query(f"SELECT doc_id, CASE WHEN d <= 29 THEN concat('2024-02-', lpad(CAST(d AS VARCHAR), 2, '0')) END AS due, concat(CAST(doc_id % 9 AS VARCHAR), '.5/', CAST(doc_id % 30 AS VARCHAR), ';1/40') AS tiers, CAST(2 AS BIGINT) AS n FROM ({duck(_TERMS)})")
def free_text_terms(spark, sf_dir):
    said = F.array("a", F.lit("  "), "b")
    kept = truth.descriptions(said)
    tiers = F.array_join(F.transform(truth.discount_tiers(kept), lambda t: F.concat_ws("/", t.percent, t.days)), ";")
    return frame(spark, sf_dir, _TERMS).select("doc_id", truth.net_due_date(kept).alias("due"), tiers.alias("tiers"), F.size(kept).cast("long").alias("n"))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_name IN ('NATION_0', 'NATION_3', 'NATION_4')")
def subset_strict(spark, sf_dir):
    return running.subset(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_name", ["NATION_4", "NATION_0", "NATION_3"])


_RUNS = """SELECT concat('exp-', CAST(o_custkey % 7 AS STRING)) AS experiment, concat('model-', CAST(o_orderkey % 3 AS STRING)) AS model_id, o_orderkey AS run_id, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey - o_orderkey % 5 END AS parent_id,
  CAST(o_orderdate AS STRING) AS started, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE CAST(o_orderkey AS STRING) END AS doc_id, CASE WHEN o_orderkey % 4 = 0 THEN 'FAILED' ELSE 'FINISHED' END AS status,
  CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_orderkey % 100 AS DOUBLE) / 100 END AS micro_f1, CASE WHEN o_orderkey % 2 = 0 THEN 0.5e0 END AS overall, CAST(o_orderkey % 10 AS DOUBLE) / 10 AS rows_f1 FROM {orders}"""
#: As ``_RUNS`` with parents spread over experiments in the same way as their children.
_STORE = _RUNS.replace("o_custkey % 7", "CAST(floor(o_orderkey / 5) AS BIGINT) % 7")


@query(f"""WITH r AS ({duck(_STORE)}), p AS (SELECT experiment, arg_max(run_id, (started, run_id)) AS parent_id FROM r WHERE parent_id IS NULL GROUP BY 1)
SELECT experiment, doc_id, status, coalesce(micro_f1, 0.0) AS micro_f1, coalesce(overall, micro_f1, 0.0) AS overall_micro_f1, rows_f1 FROM r JOIN p USING (experiment, parent_id) WHERE doc_id <> ''""")
def document_runs(spark, sf_dir):
    runs = frame(spark, sf_dir, _STORE)
    metrics = F.map_filter(F.create_map(F.lit("micro_f1"), "micro_f1", F.lit("overall_micro_f1"), "overall", F.lit("group_rows_f1"), "rows_f1", F.lit("seconds"), F.lit(1.0)), lambda _, v: v.isNotNull())
    found = running.document_runs(runs.withColumn("metrics", metrics), "experiment")
    return found.select("experiment", "doc_id", "status", "micro_f1", "overall_micro_f1", F.try_element_at("group_f1", F.lit("rows")).alias("rows_f1"))


@query(f"WITH r AS ({duck(_RUNS)}) SELECT *, rank() OVER (ORDER BY mean_f1 DESC) AS place FROM (SELECT model_id, count(*) AS n, round(avg(coalesce(micro_f1, 0.0)), 6) AS mean_f1 FROM r WHERE status = 'FINISHED' GROUP BY 1)")
def ranked_models(spark, sf_dir):
    return running.ranked_models(frame(spark, sf_dir, _RUNS))


_DOC = "SELECT model_id, doc_id, " + ratio_sql("2 * count(*) FILTER (outcome = 'TP')", "(2 * count(*) FILTER (outcome = 'TP') + count(*) FILTER (outcome = 'FP') + count(*) FILTER (outcome = 'FN'))") + " AS micro_f1, " + ratio_sql("count(*) FILTER (outcome = 'FP' AND NOT gt_present)", "count(*) FILTER (NOT gt_present)") + " AS spurious_rate FROM scored GROUP BY 1, 2"


def _asked(spark, sf_dir):
    models = table(spark, sf_dir, "orders").select(F.explode(F.array(*(F.lit(f"model-{m}") for m in range(3)))).alias("model_id"), F.col("o_orderkey").alias("doc_id"))
    return models


@query(scored_sql(f", s AS (SELECT * FROM ({_DOC}) WHERE doc_id % 10 <> 0) SELECT model_id, count(*) AS n_total, count(micro_f1) AS n_ok, count(*) - count(micro_f1) AS n_failed, round(coalesce(avg(micro_f1), 0), 6) AS mean_micro_f1, round(coalesce(avg(spurious_rate), 0), 6) AS mean_spurious_rate FROM (SELECT o_orderkey AS doc_id, concat('model-', CAST(m AS VARCHAR)) AS model_id FROM orders CROSS JOIN range(3) t(m)) LEFT JOIN s USING (model_id, doc_id) GROUP BY 1"))
def evaluation_with_failures(spark, sf_dir):
    scores = running.document_micro(scoring.score_cells(frame(spark, sf_dir, CELLS).filter("doc_id % 10 <> 0")), ["model_id", "doc_id"])
    return running.evaluation(scores, _asked(spark, sf_dir), ["model_id", "doc_id"], "model_id")


@query(scored_sql(f", s AS (SELECT * FROM ({_DOC}) WHERE doc_id % 10 <> 0) SELECT model_id, doc_id, micro_f1 IS NOT NULL AS ok, coalesce(micro_f1, 0.0) AS micro_f1, coalesce(spurious_rate, 1.0) AS spurious_rate FROM (SELECT o_orderkey AS doc_id, concat('model-', CAST(m AS VARCHAR)) AS model_id FROM orders CROSS JOIN range(3) t(m)) LEFT JOIN s USING (model_id, doc_id)"))
def failures_listed(spark, sf_dir):
    scores = running.document_micro(scoring.score_cells(frame(spark, sf_dir, CELLS).filter("doc_id % 10 <> 0")), ["model_id", "doc_id"])
    return running.with_failures(scores, _asked(spark, sf_dir), ["model_id", "doc_id"])


@query(scored_sql(f", d AS ({_DOC}) SELECT model_id, doc_id, micro_f1, spurious_rate, CASE WHEN spurious_rate > 0 OR micro_f1 < 0.75 THEN 'excluded' WHEN micro_f1 < 0.999 THEN 'flagged' ELSE 'kept' END AS verdict FROM d"))
def training_gate(spark, sf_dir):
    scores = running.document_micro(scoring.score_cells(frame(spark, sf_dir, CELLS)), ["model_id", "doc_id"])
    return running.training_gate(scores, least=0.75).select("model_id", "doc_id", "micro_f1", "spurious_rate", "verdict")


@query(f"WITH c AS ({duck(CELLS)}) SELECT doc_id, count(*) FILTER (gt_present AND gt_norm <> '') AS tp, CAST(0 AS BIGINT) AS wrong FROM c WHERE model_id = 'model-0' GROUP BY 1")
def self_score(spark, sf_dir):
    cells = running.self_scored(frame(spark, sf_dir, CELLS).filter("model_id = 'model-0'"))
    return cells.groupBy("doc_id").agg(scoring.n("TP").alias("tp"), F.count_if(F.col("outcome").isin("FP", "FN")).alias("wrong"))


_SWEEP = " UNION ALL ".join(f"SELECT model_id, field_key, {t} AS threshold, {COUNTS_SQL} FROM ({judged(str(t))}) GROUP BY 1, 2" for t in (0.5, 0.8, 0.95))


@query(scored_sql(f", swept AS ({_SWEEP}) SELECT model_id, field_key, CAST(threshold AS DOUBLE) AS threshold, tp, fp, fn, {f1_sql()} FROM swept"))
def rescore_sweep(spark, sf_dir):
    cells = scoring.read_predictions(frame(spark, sf_dir, CELLS))
    return scoring.f1(running.rescored(cells, [0.5, 0.8, 0.95], ["model_id", "field_key"]))


_IMAGES = "SELECT o_orderkey AS doc_id, 200 + o_orderkey % 1800 AS width, 300 + o_custkey * 7 % 1700 AS height FROM {orders}"
_UP = "CAST(ceil({0} / 28.0) AS BIGINT)"
_FITS = f"({_UP.format('{0}')} * 28 <= 1568 AND {_UP.format('{1}')} * 28 <= 1568 AND {_UP.format('{0}')} * {_UP.format('{1}')} <= 1568)"
_SHORT = "greatest(1, CAST(round_even(e / (CAST(greatest(width, height) AS DOUBLE) / least(width, height)), 0) AS BIGINT))"


@query(f"""WITH i AS ({duck(_IMAGES)}), e AS (SELECT width, height, unnest(range(1, greatest(width, height))) AS e FROM (SELECT DISTINCT width, height FROM i WHERE NOT {_FITS.format("width", "height")})),
s AS (SELECT *, {_SHORT} AS short FROM e), b AS (SELECT width, height, max(e) AS e FROM s WHERE {_FITS.format("e", "short")} GROUP BY 1, 2)
SELECT doc_id, CASE WHEN e IS NULL THEN i.width WHEN i.width >= i.height THEN e ELSE {_SHORT.replace("width", "i.width").replace("height", "i.height")} END AS width,
  CASE WHEN e IS NULL THEN i.height WHEN i.width >= i.height THEN {_SHORT.replace("width", "i.width").replace("height", "i.height")} ELSE e END AS height, {_FITS.format("i.width", "i.height")} AS fits
FROM i LEFT JOIN b ON i.width = b.width AND i.height = b.height""")
def image_resize(spark, sf_dir):
    w, h = F.col("width"), F.col("height")
    return frame(spark, sf_dir, _IMAGES).select("doc_id", similarity.resized(w, h, 1568, 1568).alias("r"), similarity.fits_image(w, h, 1568, 1568).alias("fits")).select("doc_id", "r.*", "fits")


@query("SELECT event_id, event_id % 97 < 0.005 * 1000 AS blank FROM events")
def blank_pages(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", similarity.is_blank_page(F.col("event_id") % 97, F.lit(1000)).alias("blank"))


_NAMES = "SELECT o_orderkey AS doc_id, concat(CASE o_orderkey % 8 WHEN 0 THEN 'EN16931_' WHEN 1 THEN 'XRECHNUNG_' WHEN 2 THEN 'Facture_BASIC WL.' WHEN 3 THEN 'zugferd-basic-' WHEN 4 THEN 'Erweitert/' WHEN 5 THEN 'NOBASICS' WHEN 6 THEN 'x_comfort_' ELSE 'minimum.' END, CAST(o_orderkey AS STRING), '.pdf') AS name, o_orderkey % 8 AS k FROM {orders}"


@query(f"""SELECT doc_id, CASE k WHEN 0 THEN 'EN16931' WHEN 1 THEN 'XRECHNUNG' ELSE 'UNKNOWN' END AS by_prefix, CASE k WHEN 0 THEN 'EN16931' WHEN 1 THEN 'XRECHNUNG' WHEN 2 THEN 'BASICWL' WHEN 3 THEN 'BASIC' WHEN 4 THEN 'EXTENDED' WHEN 7 THEN 'MINIMUM' END AS by_name,
  CASE k WHEN 0 THEN 'EN16931' WHEN 1 THEN 'XRECHNUNG' WHEN 2 THEN 'BASIC' WHEN 3 THEN 'BASIC' WHEN 5 THEN 'BASIC' WHEN 6 THEN 'COMFORT' WHEN 7 THEN 'MINIMUM' ELSE 'OTHER' END AS by_stem FROM ({duck(_NAMES)})""")
def name_profiles(spark, sf_dir):
    name = F.col("name")
    return frame(spark, sf_dir, _NAMES).select("doc_id", T.profile_of_prefix(name).alias("by_prefix"), T.profile_of_name(name).alias("by_name"), T.profile_of_stem(name).alias("by_stem"))


@query("SELECT o_orderkey AS doc_id, concat(format('{:,.2f}', o_totalprice), ' EUR') AS shown FROM orders")
def amount_display(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), T.shown_amount(F.col("o_totalprice").cast("string"), F.lit("EUR")).alias("shown"))


_FLATTENED = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query(f"""WITH f AS (SELECT doc_id, {_FLATTENED} AS t FROM documents WHERE text IS NOT NULL), p AS (SELECT *, instr(lower(t), 'the') AS p FROM f)
SELECT doc_id, concat(CASE WHEN p > 41 THEN '…' ELSE '' END, substr(t, greatest(p - 40, 1), least(length(t), p + 42) - greatest(p - 41, 0)), CASE WHEN p + 42 < length(t) THEN '…' ELSE '' END) AS seen FROM p WHERE p > 0""")
def context_around_match(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", T.context_window(F.col("text"), F.lit("the")).alias("seen")).filter("seen IS NOT NULL")


_STORED = "SELECT o_orderkey AS doc_id, CASE o_orderkey % 4 WHEN 0 THEN concat(CAST(o_custkey AS STRING), '234.50') WHEN 1 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) WHEN 2 THEN concat('DE89', lpad(CAST(o_orderkey AS STRING), 18, '0')) ELSE concat(' **Müller**  ', CAST(o_custkey AS STRING)) END AS value, CAST(o_custkey AS STRING) AS c, CAST(CAST(o_orderdate AS DATE) AS STRING) AS day FROM {orders}"
_GROUPED = "regexp_replace(regexp_replace(concat(c, '234'), '(\\d)(\\d{{3}})$', '\\1{0}\\2'), '(\\d)(\\d{{3}}[.,])', '\\1{0}\\2')"


@query(f"""WITH s AS ({duck(_STORED)}), f AS (
SELECT doc_id, unnest([concat(c, '234.50'), concat(c, '234,50'), concat({_GROUPED.format(".")}, ',50'), concat({_GROUPED.format(",")}, '.50')]) AS form FROM s WHERE doc_id % 4 = 0
UNION ALL SELECT doc_id, unnest([day, concat(substr(day, 9, 2), '.', substr(day, 6, 2), '.', substr(day, 1, 4)), concat(CAST(CAST(substr(day, 9, 2) AS INT) AS VARCHAR), '.', CAST(CAST(substr(day, 6, 2) AS INT) AS VARCHAR), '.', substr(day, 1, 4)), concat(substr(day, 9, 2), '/', substr(day, 6, 2), '/', substr(day, 1, 4)), concat(substr(day, 6, 2), '/', substr(day, 9, 2), '/', substr(day, 1, 4))]) FROM s WHERE doc_id % 4 = 1
UNION ALL SELECT doc_id, unnest([lower(value), trim(regexp_replace(lower(value), '(.{{4}})', '\\1 ', 'g'))]) FROM s WHERE doc_id % 4 = 2
UNION ALL SELECT doc_id, concat('mueller ', c) FROM s WHERE doc_id % 4 = 3) SELECT DISTINCT doc_id, form FROM f""")
def answer_forms(spark, sf_dir):
    return frame(spark, sf_dir, _STORED).select("doc_id", F.explode(T.answer_forms(F.col("value"))).alias("form"))
