"""What a run is asked to do and what it left: subsets, run stores, evaluations with failures, training pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scoring import judge, n, ratio


def subset(known: DataFrame, key: str, wanted: list[str] | None) -> DataFrame:
    """The rows of ``known`` whose key is wanted, all without a wish; a wish that nothing meets is an error.

    ``wanted`` is what a user lists, so the check collects no more than it holds.
    """
    if wanted is None:
        return known
    met = {r[0] for r in known.filter(F.col(key).isin(wanted)).select(key).distinct().collect()}
    if unknown := sorted(set(wanted) - met):
        raise ValueError(f"{key} not known: {unknown}")
    return known.filter(F.col(key).isin(wanted))


def latest_parents(runs: DataFrame, by: str) -> DataFrame:
    """The last started of the runs without a parent, for each value of ``by``."""
    return runs.filter("parent_id IS NULL").groupBy(by).agg(F.max_by("run_id", F.struct("started", "run_id")).alias("parent_id"))


def nested(runs: DataFrame, by: str, most: int = 1000) -> DataFrame:
    """The runs below each latest parent in order of start, ``most`` of each at most: the store's page size."""
    below = runs.filter("parent_id IS NOT NULL").join(latest_parents(runs, by), [by, "parent_id"], "left_semi")
    place = F.row_number().over(Window.partitionBy(by).orderBy("started", "run_id"))
    return below.withColumn("place", place).filter(F.col("place") <= most)


def document_runs(runs: DataFrame, by: str) -> DataFrame:
    """One row for each run of a document: headline score, the flat one for older runs, and scores of groups."""
    score = lambda name: F.try_element_at(F.col("metrics"), F.lit(name))
    groups = F.map_filter("metrics", lambda k, _: k.rlike("^group_.*_f1$"))
    named = F.transform_keys(groups, lambda k, _: F.regexp_extract(k, "^group_(.*)_f1$", 1))
    flat = F.coalesce(score("micro_f1"), F.lit(0.0))
    known = F.coalesce("doc_id", F.lit("")) != ""
    return nested(runs, by).filter(known).select(by, "doc_id", "status", flat.alias("micro_f1"), F.coalesce(score("overall_micro_f1"), flat).alias("overall_micro_f1"), named.alias("group_f1"))


def ranked_models(runs: DataFrame, model: str = "model_id") -> DataFrame:
    """Mean score of each model over finished runs, best first; equal means share a place."""
    means = runs.filter("status = 'FINISHED'").groupBy(model).agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("micro_f1", F.lit(0.0))), 6).alias("mean_f1"))
    return means.withColumn("place", F.rank().over(Window.orderBy(F.desc("mean_f1"))))  # one row for each model


def document_micro(cells: DataFrame, by: list[str]) -> DataFrame:
    """Micro-F1, presence F1 and spurious rate of each document from judged cells."""
    stored = F.col("gt_present")
    tp, fp, fn = (n(o) for o in ("TP", "FP", "FN"))
    absent = F.count_if(~stored)
    return cells.groupBy(*by).agg(ratio(2 * tp, 2 * tp + fp + fn).alias("micro_f1"), ratio(F.count_if(~stored & (F.col("outcome") == "FP")), absent).alias("spurious_rate"))


def evaluation(scores: DataFrame, asked: DataFrame, by: list[str], model: str) -> DataFrame:
    """Totals and means of each model over the documents ``asked``: those without a score failed.

    Failures count as such and stay out of the means; in the list they score 0 and are spurious in full.
    """
    ok = F.col("micro_f1").isNotNull()
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(f"mean_{c}")
    return asked.join(scores, by, "left").groupBy(model).agg(F.count("*").alias("n_total"), F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_failed"), mean("micro_f1"), mean("spurious_rate"))


def with_failures(scores: DataFrame, asked: DataFrame, by: list[str]) -> DataFrame:
    return asked.join(scores, by, "left").withColumn("ok", F.col("micro_f1").isNotNull()).na.fill({"micro_f1": 0.0, "spurious_rate": 1.0})


def self_scored(cells: DataFrame) -> DataFrame:
    """Judged cells of targets that answer with the stored values themselves."""
    own = cells.withColumn("pred_norm", F.col("gt_norm")).withColumn("nls", F.when((F.col("field_type") == "STRING") & (F.col("gt_norm") != ""), 1.0))
    return judge(own)


def training_gate(scores: DataFrame, least: float = 0.95, clean: float = 0.999) -> DataFrame:
    """Each target as ``kept``, ``flagged`` (kept, but under-credited) or ``excluded``."""
    broken = (F.col("spurious_rate") > 0) | (F.col("micro_f1") < least)
    return scores.withColumn("verdict", F.when(broken, "excluded").when(F.col("micro_f1") < clean, "flagged").otherwise("kept"))


def rescored(cells: DataFrame, thresholds: list[float], by: list[str]) -> DataFrame:
    """Counts at each threshold from cells read once: thresholds multiply columns, not rows."""
    sums = [n.alias(f"{c}_{k}") for k, t in enumerate(thresholds) for c, n in _counts_at(t)]
    wide = cells.groupBy(*by).agg(*sums)
    each = [F.struct(F.lit(t).alias("threshold"), *(F.col(f"{c}_{k}").alias(c) for c in ("tp", "fp", "fn"))) for k, t in enumerate(thresholds)]
    return wide.select(*by, F.explode(F.array(*each)).alias("r")).select(*by, "r.*")


def _counts_at(threshold: float) -> list[tuple[str, Column]]:
    gt, pred, stored = F.col("gt_norm"), F.col("pred_norm"), F.col("gt_present")
    content = stored & gt.isNotNull() & (gt != "")
    hit = F.coalesce(F.when(F.col("field_type") == "STRING", (F.col("nls") >= threshold) & (F.col("nls") > 0)).otherwise(gt == pred), F.lit(False))
    missed = (content & ~hit) | (stored & (gt == "") & (F.coalesce(pred, F.lit("")) != ""))
    return [("tp", F.count_if(content & hit)), ("fp", F.count_if(~stored & pred.isNotNull())), ("fn", F.count_if(missed))]
