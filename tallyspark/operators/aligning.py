"""Rows that repeat: pairing predicted with stored rows of a document, and scoring the pairs.

Predicted cells: ``doc_id, row_group, i, field_key, field_type, rule, pred_raw``. Stored cells: ``doc_id,
row_group, j, field_key, field_type, rule, gt_present, gt_norm``. ``i`` and ``j`` count rows from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import apply_rule
from ..functions.similarity import nls
from .scoring import COUNTS, f1, judge, n

PLACE = ["doc_id", "row_group"]


def row_similarity(pred: DataFrame, gold: DataFrame, threshold: float = 0.5, nfc: bool = True) -> DataFrame:
    """``doc_id, row_group, i, j, sim`` for pairs with a cell in common: matches in shares of gradable stored cells.

    Only cells with content count; a stored row without any cannot match. Cells meet by document, group
    and field, so the pairs tried are those of one document's rows and no others.
    """
    gradable = gold.filter(F.col("gt_present") & (F.col("gt_norm") != ""))
    sizes = gradable.groupBy(*PLACE, "j").agg(F.count("*").alias("n"))
    said = pred.withColumn("pred_norm", apply_rule(F.col("rule"), F.col("pred_raw"), nfc)).select(*PLACE, "i", "field_key", "pred_norm").filter("pred_norm IS NOT NULL")
    met = said.join(gradable, [*PLACE, "field_key"])
    alike = nls(F.col("pred_norm"), F.col("gt_norm"))
    hit = F.when(F.col("field_type") == "STRING", (alike >= threshold) & (alike > 0)).otherwise(F.col("pred_norm") == F.col("gt_norm"))
    hits = met.filter(hit).groupBy(*PLACE, "i", "j").agg(F.count("*").alias("hits"))
    return hits.join(sizes, [*PLACE, "j"]).select(*PLACE, "i", "j", (F.col("hits") / F.col("n")).alias("sim"))


def _fold(pairs: Column) -> Column:
    """Pairs taken in order, each whose rows are both free."""
    free = lambda taken, x: ~F.exists(taken, lambda t: (t.i == x.i) | (t.j == x.j))
    none = F.expr("CAST(array() AS array<struct<i:int,j:int>>)")
    return F.aggregate(pairs, none, lambda taken, x: F.when(free(taken, x), F.concat(taken, F.array(F.struct(x.i.alias("i"), x.j.alias("j"))))).otherwise(taken))


def greedy_match(similar: DataFrame) -> DataFrame:
    """``doc_id, row_group, i, j``: the pairs of highest similarity first, ties by ``i``, then ``j``; each row once."""
    best = F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("s"), F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"))))
    taken = similar.filter("sim > 0").groupBy(*PLACE).agg(_fold(best).alias("pairs"))
    return taken.select(*PLACE, F.explode("pairs").alias("p")).select(*PLACE, "p.i", "p.j")


def align_rows(pred: DataFrame, gold: DataFrame, threshold: float = 0.5, nfc: bool = True) -> DataFrame:
    """Matched pairs, then predicted rows without a partner (``j`` null), then stored ones (``i`` null)."""
    pairs = greedy_match(row_similarity(pred, gold, threshold, nfc))
    lone_i = pred.select(*PLACE, "i").distinct().join(pairs, [*PLACE, "i"], "left_anti").select(*PLACE, "i", F.lit(None).cast("int").alias("j"))
    lone_j = gold.select(*PLACE, "j").distinct().join(pairs, [*PLACE, "j"], "left_anti").select(*PLACE, F.lit(None).cast("int").alias("i"), "j")
    return pairs.unionByName(lone_i).unionByName(lone_j)


def _gathered(cells: DataFrame, row: str, *of: str) -> DataFrame:
    """One row for each document and group, with ``{row}_rows``: its rows, each a struct of number and ``cells``."""
    named = cells.filter(F.col("doc_id").isNotNull() & F.col("row_group").isNotNull() & F.col(row).isNotNull())
    flat = named.groupBy(*PLACE).agg(F.collect_list(F.struct(F.col(row).cast("int").alias("at"), *of)).alias("flat"))
    numbers = F.array_distinct(F.transform("flat", lambda c: c["at"]))
    rows = F.transform(numbers, lambda n: F.struct(n.alias("at"), F.filter("flat", lambda c: c["at"] == n).alias("cells")))
    return flat.select(*PLACE, rows.alias(f"{row}_rows"))


def _similar(said: Column, stored: Column, threshold: float) -> Column:
    """The pairs of ``row_similarity`` within one document and group, best first."""

    def hit(p: Column, g: Column) -> Column:
        alike = nls(p.pred_norm, g.gt_norm)
        near = alike >= threshold if threshold > 0 else alike > 0
        return (p.field_key == g.field_key) & F.when(g.field_type == "STRING", near).otherwise(p.pred_norm == g.gt_norm)

    def pair(p: Column, g: Column) -> Column:
        hits = F.aggregate(p.cells, F.lit(0), lambda n, c: n + F.size(F.filter(g.cells, lambda x: hit(c, x))))
        return F.struct((-hits / F.size(g.cells)).alias("s"), p["at"].alias("i"), g["at"].alias("j"))

    gradable = F.transform(stored, lambda g: F.struct(g["at"].alias("at"), F.filter(g.cells, lambda c: c.gt_present & (c.gt_norm != "")).alias("cells")))
    against = F.filter(gradable, lambda g: F.size(g.cells) > 0)
    pairs = F.flatten(F.transform(said, lambda p: F.transform(against, lambda g: pair(p, g))))
    return F.array_sort(F.filter(pairs, lambda x: x.s < 0))


def aligned_cells(pred: DataFrame, gold: DataFrame, threshold: float = 0.5, nfc: bool = True) -> DataFrame:
    """Judged cells of all aligned rows: a row without a partner meets cells that are absent, or said nothing of.

    Each side is gathered once, and rows are paired within a document's row, so no cell is shuffled or read
    twice; sides that come dealt by ``doc_id`` are not shuffled at all.
    """
    said = _gathered(pred.withColumn("pred_norm", apply_rule(F.col("rule"), F.col("pred_raw"), nfc)), "i", "field_key", "field_type", "rule", "pred_raw", "pred_norm")
    stored = _gathered(gold, "j", "field_key", "field_type", "rule", "gt_present", "gt_norm")
    met = said.join(stored.hint("merge"), PLACE, "full_outer").withColumns({x: F.coalesce(x, F.array()) for x in ("i_rows", "j_rows")})
    met = met.withColumn("pairs", _fold(_similar(F.col("i_rows"), F.col("j_rows"), threshold)))

    # The row of an aligned pair has one name on both sides: i where there is one, else that of j.
    cells_of = lambda rows, n: F.get(F.filter(rows, lambda r: r["at"] == n), F.lit(0)).cells
    row = lambda mark, n, p, g: F.struct(F.concat(F.lit(mark), n).alias("row"), p.alias("p"), g.alias("g"))
    no_p, no_g = (F.slice(F.flatten(F.transform(x, lambda r: r.cells)), 1, 0) for x in ("i_rows", "j_rows"))
    aligned = F.concat(
        F.transform("pairs", lambda x: row("p", x.i, cells_of(F.col("i_rows"), x.i), cells_of(F.col("j_rows"), x.j))),
        F.transform(F.filter("i_rows", lambda r: ~F.exists("pairs", lambda x: x.i == r["at"])), lambda r: row("p", r["at"], r.cells, no_g)),
        F.transform(F.filter("j_rows", lambda r: ~F.exists("pairs", lambda x: x.j == r["at"])), lambda r: row("g", r["at"], no_p, r.cells)),
    )
    rows = met.select(*PLACE, F.inline(aligned))
    # Cells that both rows have, then those of one of them.
    has = lambda cells, c: F.exists(cells, lambda x: F.coalesce(x.field_key == c.field_key, F.lit(False)))
    nothing = lambda x: F.get(x, F.lit(-1))
    both = lambda p, g: F.struct(p.alias("p"), g.alias("g"))
    cells = F.concat(
        F.flatten(F.transform("p", lambda p: F.transform(F.filter("g", lambda g: p.field_key == g.field_key), lambda g: both(p, g)))),
        F.transform(F.filter("p", lambda p: ~has("g", p)), lambda p: both(p, nothing(F.col("g")))),
        F.transform(F.filter("g", lambda g: ~has("p", g)), lambda g: both(nothing(F.col("p")), g)),
    )
    found = rows.select(*PLACE, "row", F.inline(cells))
    rule = F.coalesce("p.rule", "g.rule")
    read = found.select(
        *PLACE, "row", F.coalesce("p.field_key", "g.field_key").alias("field_key"), F.coalesce("p.field_type", "g.field_type").alias("field_type"), rule.alias("rule"), F.col("p.pred_raw").alias("pred_raw"),
        F.coalesce("g.gt_present", F.lit(False)).alias("gt_present"), F.col("g.gt_norm").alias("gt_norm"),
        # A cell said without a rule is read by that of the stored one.
        F.when(F.col("p.rule").isNull() & F.col("p.pred_raw").isNotNull(), apply_rule(rule, F.col("p.pred_raw"), nfc)).otherwise(F.col("p.pred_norm")).alias("pred_norm"),
    )
    read = read.withColumn("nls", F.when((F.col("field_type") == "STRING") & (F.col("gt_norm") != ""), nls(F.col("pred_norm"), F.col("gt_norm"))))
    return judge(read, threshold)


def group_scores(cells: DataFrame, *by: str) -> DataFrame:
    """Pooled precision, recall and F1 of aligned cells."""
    return f1(cells.groupBy(*by).agg(*(n(o).alias(c) for o, c in COUNTS)))


def overall_scores(flat: DataFrame, rows: DataFrame, *by: str) -> DataFrame:
    """Flat and row cells pooled; a document without predicted rows counts its stored rows as missed."""
    columns = [*by, "outcome"]
    return group_scores(flat.select(columns).unionByName(rows.select(columns)), *by)
