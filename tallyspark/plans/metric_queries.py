"""Queries on normalisation, outcomes, metrics, sweeps, differences and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalize, similarity
from ..operators import comparing, scoring
from .catalog import query
from .inputs import CELLS, COUNTS_SQL, READ_SQL, READINGS, _read, duck, f1_sql, frame, judged, ratio_sql, scored_sql


def _cells(spark, sf_dir):
    return frame(spark, sf_dir, CELLS)


def _scored(spark, sf_dir):
    return scoring.score_cells(_cells(spark, sf_dir), 0.5, nfc=False)


def _rule_oracle(key: str, rule: str) -> str:
    return f"WITH cells AS ({duck(CELLS)}) SELECT model_id, doc_id, pred_raw, {_read(rule)} AS canonical FROM cells WHERE field_key = '{key}'"


def _rule(key: str, read):
    return lambda spark, sf_dir: _cells(spark, sf_dir).filter(F.col("field_key") == key).select("model_id", "doc_id", "pred_raw", read(F.col("pred_raw")).alias("canonical"))


for _name, _key, _rule_name, _fn in (
    ("normalize_money", "grand_total_amount", "MONEY", normalize.money),
    ("normalize_date", "issue_date", "DATE", normalize.date),
    ("normalize_code", "buyer_reference", "CODE", lambda c: normalize.code(c, nfc=False)),
    ("normalize_text", "buyer_name", "STRING", lambda c: normalize.free_text(c, nfc=False)),
    ("invoice_number_label_strip", "invoice_number", "invoice_number", lambda c: normalize.invoice_number(c, nfc=False)),
):
    query(_rule_oracle(_key, _rule_name), _name)(_rule(_key, _fn))


_RATES = "SELECT l_orderkey AS doc_id, l_linenumber AS line, l_partkey, CAST(ROUND(l_discount * 100) AS BIGINT) AS d, (l_orderkey + l_linenumber) % 5 AS k FROM {lineitem}"
_RATE_TEXT = f"SELECT *, CASE k WHEN 0 THEN concat(CAST(d AS STRING), ' %') WHEN 1 THEN concat(CAST(d AS STRING), ',50%') WHEN 2 THEN concat(CAST(d AS STRING), '.00') WHEN 3 THEN 'zwei' ELSE concat(CAST(d * 10 AS STRING), '') END AS printed FROM ({_RATES}) r"


@query(f"SELECT doc_id, line, l_partkey, printed, CASE k WHEN 1 THEN concat(CAST(d AS STRING), '.5') WHEN 3 THEN NULL WHEN 4 THEN CAST(d * 10 AS STRING) ELSE CAST(d AS STRING) END AS canonical FROM ({duck(_RATE_TEXT)})")
def normalize_rate(spark, sf_dir):
    return frame(spark, sf_dir, _RATE_TEXT).select("doc_id", "line", "l_partkey", "printed", normalize.rate(F.col("printed")).alias("canonical"))


_SIGNED = "SELECT o_orderkey AS doc_id, CASE o_orderkey % 4 WHEN 0 THEN '0,00' WHEN 1 THEN concat('-', CAST(o_orderkey AS STRING), ',50') WHEN 2 THEN concat(CAST(o_orderkey AS STRING), '.25') ELSE '' END AS printed, o_orderkey % 4 AS k FROM {orders}"


@query(f"SELECT doc_id, printed, CASE k WHEN 1 THEN concat('-', CAST(doc_id AS STRING), '.50') WHEN 2 THEN printed END AS optional, CASE k WHEN 1 THEN concat(CAST(doc_id AS STRING), '.50') WHEN 2 THEN printed END AS unsigned FROM ({duck(_SIGNED)})")
def optional_zero_and_unsigned_money(spark, sf_dir):
    c = F.col("printed")
    return frame(spark, sf_dir, _SIGNED).select("doc_id", "printed", normalize.optional_money(c).alias("optional"), normalize.unsigned_money(c).alias("unsigned"))


_IDS = "SELECT p_partkey AS part, CASE p_partkey % 3 WHEN 0 THEN concat('TB', CAST(p_partkey AS STRING), 'A ', '4000001234578 (GTIN)') WHEN 1 THEN concat('TB', CAST(p_partkey AS STRING), 'A4012345001235(gtin)') ELSE concat('TB', CAST(p_partkey AS STRING), 'A') END AS printed FROM {part}"


@query(f"SELECT part, printed, concat('TB', CAST(part AS STRING), 'A') AS canonical FROM ({duck(_IDS)})")
def gtin_strip(spark, sf_dir):
    return frame(spark, sf_dir, _IDS).select("part", "printed", normalize.article_id(F.col("printed"), nfc=False).alias("canonical"))


_CATEGORIES = "SELECT p_partkey AS part, CASE p_partkey % 8 WHEN 0 THEN 'S' WHEN 1 THEN ' ae ' WHEN 2 THEN 'Umsatzsteuer (Z)' WHEN 3 THEN 'innergemeinschaftliche Lieferung' WHEN 4 THEN 'Reverse Charge, Umsatzsteuer' WHEN 5 THEN 'steuerfrei' WHEN 6 THEN '19 % MwSt' ELSE 'foo' END AS printed FROM {part}"


@query(f"SELECT part, printed, CASE part % 8 WHEN 0 THEN 'S' WHEN 1 THEN 'AE' WHEN 2 THEN 'Z' WHEN 3 THEN 'K' WHEN 4 THEN 'AE' WHEN 5 THEN 'E' WHEN 6 THEN 'S' ELSE 'foo' END AS category FROM ({duck(_CATEGORIES)})")
def vat_category(spark, sf_dir):
    return frame(spark, sf_dir, _CATEGORIES).select("part", "printed", normalize.vat_category(F.col("printed"), nfc=False).alias("category"))


@query("SELECT o_orderkey AS doc_id, CASE o_orderkey % 4 WHEN 0 THEN 'invoice' WHEN 1 THEN 'credit_note' WHEN 2 THEN 'correction' ELSE 'Brief' END AS token FROM orders")
def document_type_map(spark, sf_dir):
    coded = "SELECT o_orderkey AS doc_id, CASE o_orderkey % 4 WHEN 0 THEN ' 380' WHEN 1 THEN '381' WHEN 2 THEN 'Correction' ELSE 'Brief' END AS raw FROM {orders}"
    return frame(spark, sf_dir, coded).select("doc_id", normalize.document_type(F.col("raw")).alias("token"))


@query("SELECT doc_id, CASE WHEN n > 20 OR q > 60 THEN 'complex' WHEN n <= 2 AND q <= 15 THEN 'simple' ELSE 'medium' END AS tier FROM (SELECT l_orderkey AS doc_id, count(*) AS n, max(l_quantity) AS q FROM lineitem GROUP BY 1)")
def complexity_tiers(spark, sf_dir):
    docs = frame(spark, sf_dir, "SELECT l_orderkey AS doc_id, count(*) AS n, max(l_quantity) AS q FROM {lineitem} GROUP BY l_orderkey")
    return docs.select("doc_id", normalize.complexity_tier(F.col("n"), F.col("q"), (2, 15), (20, 60)).alias("tier"))


_PAIRS = "SELECT p_partkey AS part, p_name AS a, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN concat(p_name, 'x') ELSE p_brand END AS b FROM {part}"


@query(f"SELECT part, round(n, 6) AS nls, round(CASE WHEN n >= 0.7 THEN n ELSE 0.0 END, 6) AS anls FROM (SELECT part, CASE WHEN a = b THEN 1.0 ELSE 1.0 - CAST(levenshtein(a, b) AS DOUBLE) / greatest(length(a), length(b)) END AS n FROM ({duck(_PAIRS)}))")
def string_similarity(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return frame(spark, sf_dir, _PAIRS).select("part", F.round(similarity.nls(a, b), 6).alias("nls"), F.round(similarity.anls(a, b, 0.7), 6).alias("anls"))


@query(scored_sql("SELECT model_id, doc_id, field_key, pred_norm, outcome, round(score, 6) AS score FROM scored"))
def truth_table_cells(spark, sf_dir):
    return _scored(spark, sf_dir).select("model_id", "doc_id", "field_key", "pred_norm", "outcome", F.round("score", 6).alias("score"))


def _grouped_oracle(by: str, more: str, where: str = "true") -> str:
    return scored_sql(f"SELECT *, {more} FROM (SELECT {by}, {COUNTS_SQL} FROM scored WHERE {where} GROUP BY {by})")


@query(_grouped_oracle("model_id", f"{f1_sql(prefix='micro_')}, {ratio_sql('tp', '(tp + fp + fn)')} AS macro_f1"))
def micro_macro_f1(spark, sf_dir):
    return scoring.micro_macro(_scored(spark, sf_dir), "model_id")


@query(_grouped_oracle("model_id, doc_id", f"{f1_sql(prefix='micro_')}, {ratio_sql('tp', '(tp + fp + fn)')} AS macro_f1"))
def document_scores(spark, sf_dir):
    return scoring.micro_macro(_scored(spark, sf_dir), "model_id", "doc_id")


@query(_grouped_oracle("model_id, field_key", f1_sql(), "outcome IN ('TP', 'FP', 'FN')"))
def label_f1(spark, sf_dir):
    return scoring.label_f1(_scored(spark, sf_dir), "model_id")


@query(_grouped_oracle("model_id", f1_sql(prefix="presence_"), "gt_present AND outcome <> 'EXCLUDED'"))
def presence_f1(spark, sf_dir):
    return scoring.presence_f1(_scored(spark, sf_dir), "model_id")


@query(scored_sql(f"SELECT *, {ratio_sql('n_spurious', 'n_absent')} AS spurious_rate FROM (SELECT model_id, count(*) FILTER (outcome = 'FP') AS n_spurious, count(*) AS n_absent FROM scored WHERE NOT gt_present GROUP BY 1)"))
def spurious_rate(spark, sf_dir):
    return scoring.spurious_rate(_scored(spark, sf_dir), "model_id")


_GROUPS = f"""SELECT model_id, count(*) FILTER (w) AS g_tp, count(*) FILTER (NOT w) AS g_fp, count(*) FILTER (NOT w AND (tp > 0 OR fn > 0)) AS g_fn FROM
(SELECT *, fp = 0 AND fn = 0 AS w FROM (SELECT model_id, doc_id, field_group, {COUNTS_SQL} FROM scored WHERE field_group <> '' AND outcome IN ('TP', 'FP', 'FN') GROUP BY ALL)) GROUP BY 1"""


@query(scored_sql(f"SELECT *, {f1_sql('g_tp', 'g_fp', 'g_fn', 'group_')} FROM ({_GROUPS})"))
def group_level_f1(spark, sf_dir):
    return scoring.group_level_f1(_scored(spark, sf_dir), "model_id")


@query(scored_sql(f"SELECT model_id, field_key, {', '.join(f'''count(*) FILTER (outcome = '{o}') AS n_{o.lower()}''' for o in scoring.OUTCOMES)} FROM scored GROUP BY 1, 2"))
def outcome_pivot(spark, sf_dir):
    return scoring.outcome_pivot(_scored(spark, sf_dir), "model_id", "field_key")


@query(scored_sql("SELECT model_id, field_key, round(avg(score), 6) AS mean_score, count(*) AS n_cells FROM scored WHERE outcome IN ('TP', 'FP', 'FN') GROUP BY 1, 2"))
def score_heatmap(spark, sf_dir):
    return scoring.score_heatmap(_scored(spark, sf_dir), "model_id", "field_key")


@query(scored_sql(f"SELECT *, {f1_sql()} FROM (SELECT CASE WHEN grouping(profile) = 1 THEN 'POOLED' ELSE profile END AS profile, {COUNTS_SQL} FROM scored GROUP BY GROUPING SETS ((scored.profile), ()))"))
def profile_rollup(spark, sf_dir):
    return scoring.rollup_f1(_scored(spark, sf_dir), "profile")


@query(_grouped_oracle("model_id, field_type", f1_sql()))
def type_f1(spark, sf_dir):
    return scoring.f1(scoring.outcome_counts(_scored(spark, sf_dir), "model_id", "field_type"))


_TAUS = [0.3, 0.5, 0.9]
_SWEEP = " JOIN ".join(f"(SELECT model_id, {ratio_sql('2 * tp', '(2 * tp + fp + fn)')} AS f1_{str(t).replace('.', '_')}0 FROM (SELECT model_id, {COUNTS_SQL} FROM ({judged(str(t))}) GROUP BY 1)) t{n}" + (" USING (model_id)" if n else "") for n, t in enumerate(_TAUS))


@query(f"WITH cells AS ({duck(CELLS)}), {READ_SQL} SELECT *, round(greatest(f1_0_30, f1_0_50, f1_0_90) - least(f1_0_30, f1_0_50, f1_0_90), 6) AS span FROM {_SWEEP}")
def threshold_sweep(spark, sf_dir):
    return scoring.threshold_sweep(scoring.read_predictions(_cells(spark, sf_dir), nfc=False), _TAUS, "model_id")


def _arms(spark, sf_dir):
    """F1 of each field by the first two models, as reports before and after."""
    f1 = scoring.label_f1(_scored(spark, sf_dir).filter("model_id <> 'model-2'"), "model_id")
    pick = lambda m: f1.filter(F.col("model_id") == m).select("field_key", "f1", "tp", "fp", "fn")
    return pick("model-0").filter("field_key <> 'issue_date'"), pick("model-1").filter("field_key <> 'buyer_reference'")


_ARMS = f"""f AS (SELECT *, {f1_sql()} FROM (SELECT model_id, field_key, {COUNTS_SQL} FROM scored WHERE outcome IN ('TP', 'FP', 'FN') GROUP BY 1, 2)),
a AS (SELECT * FROM f WHERE model_id = 'model-0' AND field_key <> 'issue_date'), b AS (SELECT * FROM f WHERE model_id = 'model-1' AND field_key <> 'buyer_reference')"""


@query(scored_sql(f", {_ARMS} SELECT field_key, a.f1 AS f1_before, b.f1 AS f1_after, round(b.f1 - a.f1, 6) AS delta, CASE WHEN a.f1 IS NULL THEN 'NEW' WHEN b.f1 IS NULL THEN 'GONE' WHEN abs(b.f1 - a.f1) > 0.00005 THEN 'MOVE' ELSE 'SAME' END AS change FROM a FULL JOIN b USING (field_key)"))
def report_diff(spark, sf_dir):
    before, after = _arms(spark, sf_dir)
    return comparing.report_diff(before, after, "field_key")


@query(scored_sql(", d AS (SELECT field_key, count(*) FILTER (model_id = 'model-0' AND outcome = 'TP') AS tp_baseline, count(*) FILTER (model_id = 'model-1' AND outcome = 'TP') AS tp_candidate FROM scored GROUP BY 1) SELECT *, tp_candidate - tp_baseline AS delta_tp FROM d"))
def ab_delta(spark, sf_dir):
    scored = _scored(spark, sf_dir)
    return comparing.ab_delta(scored.filter("model_id = 'model-0'"), scored.filter("model_id = 'model-1'"), "field_key")


_GAP = "CASE WHEN b.tp + b.fp + b.fn = 0 THEN 'untested' WHEN b.f1 >= 0.95 AND a.f1 >= 0.95 THEN 'closed' WHEN b.f1 >= 0.95 THEN 'reading-gap' WHEN b.fp + b.fn < 3 THEN 'marginal' WHEN b.fp > b.fn THEN 'label-mapping' ELSE 'prompt-candidate' END"


@query(scored_sql(f", {_ARMS} SELECT field_key, round(b.f1 - a.f1, 6) AS gap, {_GAP} AS verdict FROM a JOIN b USING (field_key)"))
def gap_verdict(spark, sf_dir):
    reader, oracle = _arms(spark, sf_dir)
    return comparing.gap_verdict(reader, oracle, adequate=0.95, min_errors=3)


_ARM_SCORES = "SELECT model_id, doc_id % 2 AS arm, count(pred_norm) AS n_keys, count(*) FILTER (outcome = 'TP') AS tp, count(*) FILTER (outcome = 'FP') AS fp, count(*) FILTER (outcome = 'FN') AS fn FROM scored GROUP BY 1, 2"
_SPECS = "(SELECT unnest([struct_pack(keys := 12, f1 := 0.0), struct_pack(keys := 12, f1 := 0.8)]) AS s, unnest([false, true]) AS amended)"


@query(scored_sql(f", m AS (SELECT model_id, amended, max(CASE WHEN n_keys >= s.keys AND {ratio_sql('2 * tp', '(2 * tp + fp + fn)')} >= s.f1 THEN 1 ELSE 0 END) AS ok FROM ({_ARM_SCORES}) CROSS JOIN {_SPECS} GROUP BY 1, 2) SELECT amended, CAST(sum(ok) AS BIGINT) AS n_pass, coalesce(string_agg(model_id, ',' ORDER BY model_id) FILTER (ok = 1), '') AS passed, CASE WHEN sum(ok) >= 2 THEN 'FILE' ELSE 'DEFER' END AS verdict FROM m GROUP BY 1"))
def verdict_matrix(spark, sf_dir):
    scored = _scored(spark, sf_dir).withColumn("arm", F.col("doc_id") % 2)
    return comparing.verdict_matrix(scored, min_keys=12, amended_f1=0.8, pass_count=2)


@query(scored_sql(f"SELECT coalesce(model_id, 'ALL') AS model_id, {ratio_sql('2 * tp', '(2 * tp + fp + fn)')} AS presence_f1, {ratio_sql('n_spurious', 'n_absent')} AS spurious_rate FROM (SELECT model_id, count(*) FILTER (gt_present AND outcome = 'TP') AS tp, count(*) FILTER (gt_present AND outcome = 'FP') AS fp, count(*) FILTER (gt_present AND outcome = 'FN') AS fn, count(*) FILTER (NOT gt_present AND outcome = 'FP') AS n_spurious, count(*) FILTER (NOT gt_present) AS n_absent FROM scored GROUP BY ROLLUP (model_id))"))
def extended_metrics_rollup(spark, sf_dir):
    return comparing.extended_rollup(_scored(spark, sf_dir), "model_id")


@query(scored_sql(f"SELECT segment, profile, {ratio_sql('2 * tp', '(2 * tp + fp + fn)')} AS f1, tp, fp, fn FROM (SELECT coalesce(segment, 'ALL') AS segment, coalesce(profile, 'ALL') AS profile, {COUNTS_SQL} FROM scored GROUP BY GROUPING SETS ((scored.segment, scored.profile), (scored.segment), (scored.profile)))"))
def breakdown_grouping_sets(spark, sf_dir):
    return comparing.breakdown(_scored(spark, sf_dir), "segment", "profile")


@query(scored_sql("SELECT field_group, field_key, count(*) FILTER (nls > 0) AS fn_readable, count(*) FILTER (NOT coalesce(nls > 0, false)) AS fn_unreadable FROM scored WHERE outcome = 'FN' GROUP BY 1, 2"))
def fn_attribution(spark, sf_dir):
    return comparing.fn_attribution(_scored(spark, sf_dir), F.coalesce(F.col("nls") > 0, F.lit(False)))


@query(scored_sql(", p AS (SELECT field_key, doc_id, max(CASE WHEN model_id = 'model-0' THEN outcome END) AS model_0, max(CASE WHEN model_id = 'model-1' THEN outcome END) AS model_1, max(CASE WHEN model_id = 'model-2' THEN outcome END) AS model_2 FROM scored GROUP BY 1, 2) SELECT * FROM p"))
def field_by_model_matrix(spark, sf_dir):
    return comparing.outcome_matrix(_scored(spark, sf_dir), ["model-0", "model-1", "model-2"])


@query("SELECT model_id, count(*) AS n, round(sum(tokens) / sum(tokens / tps) , 6) AS decode_tps, max(k) AS peak FROM (SELECT event_type AS model_id, CAST(event_id % 50 + 1 AS DOUBLE) AS tokens, CAST(event_id % 7 + 1 AS DOUBLE) AS tps, event_id % 13 AS k FROM events) GROUP BY 1")
def perf_summary(spark, sf_dir):
    runs = frame(spark, sf_dir, "SELECT event_type AS model_id, CAST(event_id % 50 + 1 AS DOUBLE) AS tokens, CAST(event_id % 7 + 1 AS DOUBLE) AS tps, event_id % 13 AS k FROM {events}")
    return comparing.perf_summary(runs, "model_id", "tokens", "tps", "k")


@query("SELECT model_id, doc_id, k, cents FROM (" + duck(READINGS) + ") WHERE k NOT IN (0, 1)", "resume_filter")
def _resume(spark, sf_dir):
    readings = frame(spark, sf_dir, READINGS)
    finished = readings.filter("k IN (0, 1)").select("model_id", "doc_id")
    return comparing.not_finished(readings, finished, "model_id", "doc_id").select("model_id", "doc_id", "k", "cents")
