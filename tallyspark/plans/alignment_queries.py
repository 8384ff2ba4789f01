"""Queries on repeating rows, with order lines as stored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aligning
from .catalog import query
from .inputs import duck, f1_sql, frame

_PLACE = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate)"
_LINE = "l_linenumber, concat('part-', CAST(l_partkey AS STRING)) AS name, CAST(ROUND(l_extendedprice * 100) AS BIGINT) AS cents, CAST(l_quantity AS BIGINT) AS quantity"

#: Stored rows: the lines of an order, numbered from 0, with amounts in cents.
LINES = f"""
SELECT l_orderkey AS doc_id, CAST({_PLACE} - 1 AS INT) AS j,
       {_LINE}
FROM {{lineitem}}
"""

#: The same, with nothing computed before the window, so that Spark still knows its result as dealt by ``doc_id``.
DEALT = f"SELECT l_orderkey AS doc_id, CAST(place - 1 AS INT) AS j, {_LINE} FROM (SELECT *, {_PLACE} AS place FROM {{lineitem}})"

#: Predicted rows: every 4th is missing, every 9th comes twice, every 5th has another amount.
SAID = """
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY j, copy) - 1 AS INT) AS i, name, quantity, cents + CASE WHEN (doc_id + j) % 5 = 0 THEN 1 ELSE 0 END AS cents
FROM (SELECT * FROM lines WHERE (doc_id + j) % 4 <> 0) l JOIN (SELECT 0 AS copy UNION ALL SELECT 1 AS copy) c ON copy = 0 OR (doc_id + j) % 9 = 0
"""


def _parts() -> tuple[tuple[str, str, str], ...]:
    amount = "concat(CAST(CAST(FLOOR(cents / 100) AS BIGINT) AS STRING), '.', lpad(CAST(cents % 100 AS STRING), 2, '0'))"
    return (("name", "STRING", "name"), ("quantity", "MONEY", "concat(CAST(quantity AS STRING), '.00')"), ("line_amount", "MONEY", amount))


def _long(table: str, row: str, columns: str) -> str:
    return " UNION ALL ".join(f"SELECT doc_id, 'line_items' AS row_group, {row}, '{k}' AS field_key, '{t}' AS field_type, '{t}' AS rule, {columns.format(v=v)} FROM {table}" for k, t, v in _parts())


def _at_once(table: str, row: str, columns: str) -> str:
    """The rows of ``_long``, from one pass over ``table``, in Spark's SQL."""
    cells = ", ".join(f"named_struct('field_key', '{k}', 'field_type', '{t}', 'rule', '{t}', {columns.format(v=v)})" for k, t, v in _parts())
    return f"SELECT doc_id, 'line_items' AS row_group, {row}, inline(array({cells})) FROM {table}"


GOLD = f"WITH lines AS ({LINES}) {_long('lines', 'j', 'true AS gt_present, {v} AS gt_norm')}"
PRED = f"WITH lines AS ({LINES}), said AS ({SAID}) {_long('said', 'i', '{v} AS pred_raw')}"

_SIM = f"""gold AS ({duck(GOLD)}), pred AS ({duck(PRED)}),
hits AS (SELECT doc_id, row_group, i, j, count(*) AS hits FROM pred JOIN gold USING (doc_id, row_group, field_key) WHERE CASE WHEN gold.field_type = 'STRING' THEN
  CASE WHEN pred_raw = gt_norm THEN 1.0 ELSE 1.0 - CAST(levenshtein(pred_raw, gt_norm) AS DOUBLE) / greatest(length(pred_raw), length(gt_norm)) END >= 0.5 ELSE pred_raw = gt_norm END GROUP BY ALL),
sims AS (SELECT doc_id, row_group, i, j, hits / 3 AS sim FROM hits)"""

_MATCH = f"""{_SIM}, folded AS (SELECT doc_id, row_group, list_reduce(list_transform(list_sort(list(struct_pack(s := -sim, i := i, j := j))), lambda x: struct_pack(i := x.i, j := x.j)),
  lambda taken, x: CASE WHEN len(list_filter(taken, lambda t: t.i = x[1].i OR t.j = x[1].j)) > 0 THEN taken ELSE list_append(taken, x[1]) END, CAST([] AS STRUCT(i INTEGER, j INTEGER)[])) AS pairs FROM
  (SELECT doc_id, row_group, sim, i, j FROM sims) GROUP BY 1, 2)"""
_MATCH = _MATCH.replace("list_transform(list_sort(", "list_transform(list_transform(list_sort(").replace("struct_pack(i := x.i, j := x.j))", "struct_pack(i := x.i, j := x.j)), lambda y: [y])")
_MATCH = _MATCH.replace("CAST([] AS STRUCT(i INTEGER, j INTEGER)[])", "CAST([] AS STRUCT(i INTEGER, j INTEGER)[])")
_PAIRS = f"{_MATCH}, pairs AS (SELECT doc_id, row_group, unnest(pairs) AS p FROM folded), matched AS (SELECT doc_id, row_group, p.i AS i, p.j AS j FROM pairs)"


def _inputs(spark, sf_dir):
    return frame(spark, sf_dir, PRED), frame(spark, sf_dir, GOLD)


@query(f"WITH {_SIM} SELECT doc_id, row_group, i, j, round(sim, 6) AS sim FROM sims")
def row_similarity(spark, sf_dir):
    return aligning.row_similarity(*_inputs(spark, sf_dir), 0.5, nfc=False).withColumn("sim", F.round("sim", 6))


@query(f"WITH {_PAIRS} SELECT doc_id, row_group, i, j FROM matched")
def greedy_row_match(spark, sf_dir):
    return aligning.greedy_match(aligning.row_similarity(*_inputs(spark, sf_dir), 0.5, nfc=False))


_ALIGNED = f"""{_PAIRS}, rows AS (SELECT doc_id, i, j FROM matched UNION ALL SELECT DISTINCT doc_id, i, CAST(NULL AS INTEGER) FROM pred ANTI JOIN matched USING (doc_id, i)
 UNION ALL SELECT DISTINCT doc_id, CAST(NULL AS INTEGER), j FROM gold ANTI JOIN matched USING (doc_id, j)),
keys AS (SELECT * FROM rows CROSS JOIN (SELECT unnest(['name', 'quantity', 'line_amount']) AS field_key)),
scored AS (SELECT k.doc_id, CASE WHEN gt_norm IS NULL THEN CASE WHEN pred_raw IS NULL THEN 'TN' ELSE 'FP' END
  WHEN coalesce(CASE WHEN gold.field_type = 'STRING' THEN CASE WHEN pred_raw = gt_norm THEN 1.0 ELSE 1.0 - CAST(levenshtein(pred_raw, gt_norm) AS DOUBLE) / greatest(length(pred_raw), length(gt_norm)) END >= 0.5 ELSE pred_raw = gt_norm END, false) THEN 'TP' ELSE 'FN' END AS outcome
  FROM keys k LEFT JOIN pred ON k.doc_id = pred.doc_id AND k.i = pred.i AND k.field_key = pred.field_key LEFT JOIN gold ON k.doc_id = gold.doc_id AND k.j = gold.j AND k.field_key = gold.field_key)"""


@query(f"WITH {_ALIGNED} SELECT *, {f1_sql()} FROM (SELECT doc_id, count(*) FILTER (outcome = 'TP') AS tp, count(*) FILTER (outcome = 'FP') AS fp, count(*) FILTER (outcome = 'FN') AS fn FROM scored GROUP BY 1)")
def group_f1(spark, sf_dir):
    gold = frame(spark, sf_dir, f"WITH lines AS ({DEALT}) {_at_once('lines', 'j', "'gt_present', true, 'gt_norm', {v}")}")
    pred = frame(spark, sf_dir, f"WITH lines AS ({DEALT}), said AS ({SAID}) {_at_once('said', 'i', "'pred_raw', {v}")}")
    return aligning.group_scores(aligning.aligned_cells(pred, gold, 0.5, nfc=False), "doc_id")
