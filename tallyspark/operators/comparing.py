"""Reports against reports: differences, deltas, verdicts, attributions and breakdowns over judged cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scoring import COUNTS, count_if, f1, n, outcome_counts, ratio

#: Differences of F1 up to this are none.
STILL = 5e-5


def report_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """What is new, gone, moved or the same between two reports of F1 by ``key``."""
    a, b = before.select(key, F.col("f1").alias("f1_before")), after.select(key, F.col("f1").alias("f1_after"))
    delta = F.col("f1_after") - F.col("f1_before")
    change = F.when(F.col("f1_before").isNull(), "NEW").when(F.col("f1_after").isNull(), "GONE").when(F.abs(delta) > STILL, "MOVE").otherwise("SAME")
    return a.join(b, key, "full_outer").withColumns({"delta": F.round(delta, 6), "change": change})


def ab_delta(baseline: DataFrame, candidate: DataFrame, key: str) -> DataFrame:
    """True positives of two arms by ``key`` and their difference."""
    hits = lambda cells, name: cells.groupBy(key).agg(n("TP").alias(name))
    both = hits(baseline, "tp_baseline").join(hits(candidate, "tp_candidate"), key, "full_outer").na.fill(0)
    return both.withColumn("delta_tp", F.col("tp_candidate") - F.col("tp_baseline"))


def gap_verdict(reader: DataFrame, oracle: DataFrame, adequate: float = 0.95, min_errors: int = 3) -> DataFrame:
    """Why a field falls short, from its counts on what was read and on perfect transcripts."""
    r = reader.select("field_key", F.col("f1").alias("reader_f1"))
    joined = r.join(oracle, "field_key")
    errors = F.col("fp") + F.col("fn")
    verdict = (
        F.when(F.col("tp") + errors == 0, "untested")
        .when((F.col("f1") >= adequate) & (F.col("reader_f1") >= adequate), "closed")
        .when(F.col("f1") >= adequate, "reading-gap")
        .when(errors < min_errors, "marginal")
        .when(F.col("fp") > F.col("fn"), "label-mapping")
        .otherwise("prompt-candidate")
    )
    return joined.select("field_key", F.round(F.col("f1") - F.col("reader_f1"), 6).alias("gap"), verdict.alias("verdict"))


def verdict_matrix(cells: DataFrame, min_keys: int, amended_f1: float, pass_count: int) -> DataFrame:
    """By rule, plain or amended by a least F1: how many models pass in either arm, which, and the verdict."""
    arms = cells.groupBy("model_id", "arm").agg(F.count("pred_norm").alias("n_keys"), *(n(o).alias(c) for o, c in COUNTS))
    value = ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    passes = lambda least: F.max((F.col("n_keys") >= min_keys) & (value >= least))
    models = arms.groupBy("model_id").agg(passes(0.0).alias("plain"), passes(amended_f1).alias("strict"))
    long = models.select("model_id", F.explode(F.array(F.struct(F.lit(False).alias("amended"), F.col("plain").alias("ok")), F.struct(F.lit(True).alias("amended"), F.col("strict").alias("ok")))).alias("r")).select("model_id", "r.*")
    out = long.groupBy("amended").agg(count_if(F.col("ok")).alias("n_pass"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("ok"), F.col("model_id")))), ",").alias("passed"))
    return out.withColumn("verdict", F.when(F.col("n_pass") >= pass_count, "FILE").otherwise("DEFER"))


def extended_rollup(cells: DataFrame, by: str) -> DataFrame:
    """Presence F1 and spurious rate of each value of ``by`` and of all."""
    stored, hit = F.col("gt_present"), lambda o: F.col("outcome") == o
    sums = cells.rollup(by).agg(*(count_if(stored & hit(o)).alias(c) for o, c in COUNTS), count_if(~stored & hit("FP")).alias("s"), count_if(~stored).alias("absent"))
    return sums.select(F.coalesce(by, F.lit("ALL")).alias(by), ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("presence_f1"), ratio(F.col("s"), F.col("absent")).alias("spurious_rate"))


def breakdown(cells: DataFrame, a: str, b: str) -> DataFrame:
    """F1 by both keys and by each alone, in one pass of grouping sets."""
    sums = cells.groupingSets([[a, b], [a], [b]], a, b).agg(*(n(o).alias(c) for o, c in COUNTS))
    named = sums.withColumns({k: F.coalesce(k, F.lit("ALL")) for k in (a, b)})
    return named.select(a, b, ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"), "tp", "fp", "fn")


def fn_attribution(cells: DataFrame, readable: Column) -> DataFrame:
    """Misses by group and field: those whose value could be read, and the others."""
    return cells.filter("outcome = 'FN'").groupBy("field_group", "field_key").agg(count_if(readable).alias("fn_readable"), count_if(~readable).alias("fn_unreadable"))


def outcome_matrix(cells: DataFrame, models: list[str]) -> DataFrame:
    """The outcome of each document's field, a column for each model."""
    out = cells.groupBy("field_key", "doc_id").pivot("model_id", models).agg(F.first("outcome"))
    return out.select("field_key", "doc_id", *(F.col(f"`{m}`").alias(m.replace("-", "_")) for m in models))


def perf_summary(runs: DataFrame, by: str, tokens: str, rate: str, peak: str) -> DataFrame:
    """Tokens over the time they took, not the mean of rates; runs without a rate are left out of it."""
    seconds = F.sum(F.when(F.col(rate) > 0, F.col(tokens) / F.col(rate)))
    return runs.groupBy(by).agg(F.count("*").alias("n"), F.round(F.try_divide(F.sum(F.when(F.col(rate) > 0, F.col(tokens))), seconds), 6).alias("decode_tps"), F.max(peak).alias("peak"))


def not_finished(wanted: DataFrame, finished: DataFrame, *key: str) -> DataFrame:
    return wanted.join(finished, list(key), "left_anti")


def mean_or_zero(value: str) -> Column:
    return F.coalesce(F.avg(value), F.lit(0.0))


def eval_report(cells: DataFrame, ok: DataFrame) -> DataFrame:
    """Pooled F1 of each field over documents that were read; failed ones are in ``ok`` with ``ok = false``."""
    return f1(outcome_counts(cells.join(ok.filter("ok"), "doc_id", "left_semi"), "field_key"))
