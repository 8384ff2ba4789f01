"""Queries on adjudication: three channels read the amount and the name on each order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import adjudicating
from .catalog import query
from .inputs import frame

#: By ``k`` the channels agree, differ, are silent or cannot say; ``proven`` is given, as from an evidence check.
READINGS = """
SELECT o_orderkey AS doc_id, 'amount' AS key, CASE WHEN o_orderkey % 13 = 0 THEN 'exempt' ELSE 'code' END AS policy, n AS ord, concat('c', CAST(n AS STRING)) AS channel, CAST(o_orderkey % 11 AS INT) AS k,
       CASE WHEN o_orderkey % 11 = 0 THEN CAST(NULL AS STRING)
            WHEN o_orderkey % 11 = 1 THEN CASE WHEN n = 0 THEN 'A1' END
            WHEN o_orderkey % 11 = 2 THEN CASE WHEN n = 2 THEN 'B2' ELSE 'A1' END
            WHEN o_orderkey % 11 = 3 THEN concat('X', CAST(n AS STRING))
            WHEN o_orderkey % 11 = 4 THEN CASE WHEN n = 0 THEN 'A1' WHEN n = 1 THEN 'B2' END
            WHEN o_orderkey % 11 = 5 THEN CASE WHEN n < 2 THEN ' A1 ' END
            ELSE 'A1' END AS value,
       NOT (o_orderkey % 11 = 0 AND o_orderkey % 2 = 0) AS covered,
       (o_orderkey % 11 IN (2, 6, 8) OR (o_orderkey % 11 = 4 AND n = 0)) AND n <> 2 AS proven,
       o_orderkey % 11 = 9 AS weak, o_orderkey % 11 = 10 AS unparseable
FROM {orders} CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1 AS n UNION ALL SELECT 2 AS n) c
"""

_TREE = """SELECT o_orderkey AS doc_id, 'amount' AS key, o_orderkey % 11 AS k, o_orderkey % 13 = 0 AS exempt, o_orderkey % 2 = 0 AS even FROM orders"""
_DECIDED = f"""SELECT doc_id, key,
 CASE WHEN k = 0 THEN 'null-claim' WHEN k = 2 THEN 'text-layer-proven' WHEN k IN (3, 4) THEN 'author-adjudicated'
      WHEN exempt THEN CASE WHEN k = 1 THEN 'exempt-by-policy' ELSE 'two-channel-agreed' END
      WHEN k = 10 THEN 'author-adjudicated' WHEN k IN (6, 8) THEN 'text-layer-proven' WHEN k = 1 THEN 'author-adjudicated' ELSE 'two-channel-agreed' END AS provenance,
 CASE WHEN k IN (0, 3, 4) THEN NULL WHEN k = 5 THEN ' A1 ' ELSE 'A1' END AS value,
 CAST(CASE WHEN k = 0 THEN CASE WHEN even THEN 1 END WHEN k = 2 THEN NULL WHEN k = 3 THEN 2 WHEN k = 4 THEN 3 WHEN exempt THEN CASE WHEN k = 1 THEN 7 END
      WHEN k = 10 THEN 6 WHEN k = 1 THEN 4 END AS INTEGER) AS rank,
 CAST(CASE WHEN k = 0 THEN CASE WHEN even THEN 0 ELSE 3 END WHEN k = 2 THEN 2 WHEN k IN (3, 4, 1) THEN 1 WHEN k = 5 THEN 2 ELSE 3 END AS INTEGER) AS n_agreeing
FROM ({_TREE})"""


def _decided(spark, sf_dir):
    readings = frame(spark, sf_dir, READINGS)
    return adjudicating.adjudicate(readings.withColumn("canonical", adjudicating.canonical_form(F.col("value"), F.col("policy"), unicode=False)))


@query(_DECIDED)
def adjudicate_cells(spark, sf_dir):
    return _decided(spark, sf_dir)


_LABELS = ", ".join(f"'{r}'" for r in adjudicating.RANKS)


@query(f"SELECT provenance, rank, count(*) AS n_cells, count(*) FILTER (rank IS NULL) AS n_accepted, [{_LABELS}][rank] AS label FROM ({_DECIDED}) GROUP BY ALL")
def collapse_summary(spark, sf_dir):
    return adjudicating.decision_summary(_decided(spark, sf_dir))


def _answers(spark, sf_dir):
    return frame(spark, sf_dir, "SELECT o_orderkey AS doc_id, 'amount' AS key, CASE WHEN o_orderkey % 2 = 0 THEN 'A9' END AS answer FROM {orders} WHERE o_orderkey % 3 = 0")


_PROMOTED = f"""SELECT doc_id, key, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'A9' END WHEN rank IS NULL THEN value END AS value,
 CASE WHEN doc_id % 3 = 0 AND rank IS NOT NULL THEN 'author-adjudicated' ELSE provenance END AS provenance, rank IS NOT NULL AND doc_id % 3 <> 0 AS pending FROM ({_DECIDED})"""


@query(_PROMOTED)
def promoted_values(spark, sf_dir):
    return adjudicating.promote(_decided(spark, sf_dir), _answers(spark, sf_dir))


@query(f"SELECT doc_id, count(*) AS n_cells, count(*) FILTER (pending) AS n_pending, count(*) FILTER (pending) = 0 AS verified FROM ({_PROMOTED}) GROUP BY 1")
def promotion_status(spark, sf_dir):
    return adjudicating.promotion_status(adjudicating.promote(_decided(spark, sf_dir), _answers(spark, sf_dir)))
