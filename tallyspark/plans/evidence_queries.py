"""Queries on printed evidence, with pages rendered from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence, leaking
from .catalog import query
from .inputs import _amount, duck, frame

#: Orders and the page printed of each: the amount in German or Anglo form or not at all, the day with dots, slashes or not at all.
PAGES = f"""
SELECT doc_id, name, day, {_amount("cents", "", ".")} AS amount, o % 3 AS k, o % 4 AS j,
       concat('Rechnung', chr(10), CASE WHEN o % 5 = 0 THEN 'ohne Namen' ELSE upper(name) END, chr(10), 'Summe: ',
              CASE o % 3 WHEN 0 THEN {_amount("cents", ".", ",")} WHEN 1 THEN {_amount("cents", ",", ".")} ELSE 'siehe Anlage' END, ' EUR', chr(10), 'Datum: ',
              CASE o % 4 WHEN 0 THEN concat(substr(day, 9, 2), '.', substr(day, 6, 2), '.', substr(day, 1, 4)) WHEN 1 THEN concat(substr(day, 6, 2), '/', substr(day, 9, 2), '/', substr(day, 1, 4)) WHEN 2 THEN day ELSE 'folgt' END) AS page
FROM (SELECT o_orderkey AS doc_id, o_orderkey AS o, c_name AS name, CAST(CAST(o_orderdate AS DATE) AS STRING) AS day, CAST(ROUND(o_totalprice * 100) AS BIGINT) AS cents FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey) r
"""

_EXPECTED = f"""SELECT doc_id, 'amount' AS key, CASE WHEN k < 2 THEN 'found' ELSE 'not_found' END AS status FROM ({duck(PAGES)})
UNION ALL SELECT doc_id, 'day', CASE WHEN j < 3 THEN 'found' ELSE 'not_found' END FROM ({duck(PAGES)})
UNION ALL SELECT doc_id, 'name', CASE WHEN doc_id % 5 = 0 THEN 'not_found' ELSE 'found' END FROM ({duck(PAGES)})"""


def _checked(spark, sf_dir):
    pages = frame(spark, sf_dir, PAGES)
    cells = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(p).alias("policy"), F.col(k).alias("value")) for k, p in (("amount", "money"), ("day", "date"), ("name", "text"))))
    long = pages.select("doc_id", "page", F.explode(cells).alias("c")).select("doc_id", "page", "c.*")
    return long.select("doc_id", "key", evidence.check(F.col("value"), F.col("policy"), F.col("page"), unicode=False).alias("e")).select("doc_id", "key", "e.*")


@query(_EXPECTED)
def evidence_check(spark, sf_dir):
    return _checked(spark, sf_dir).select("doc_id", "key", "status")


@query(f"SELECT key, status, count(*) AS n FROM ({_EXPECTED}) GROUP BY 1, 2")
def evidence_summary(spark, sf_dir):
    return _checked(spark, sf_dir).groupBy("key", "status").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, count(*) FILTER (status = 'found') AS n_found, round(count(*) FILTER (status = 'found') / 3, 6) AS share, CASE WHEN count(*) FILTER (status = 'found') >= 2 THEN 'A' WHEN count(*) FILTER (status = 'found') = 1 THEN 'A?' ELSE 'B' END AS tier FROM ({_EXPECTED}) GROUP BY 1")
def answerability(spark, sf_dir):
    found = F.count_if(F.col("status") == "found").cast("long")
    docs = _checked(spark, sf_dir).groupBy("doc_id").agg(found.alias("n_found"), F.round(found / F.count("*"), 6).alias("share"))
    return docs.withColumn("tier", F.when(F.col("share") >= 0.5, "A").when(F.col("n_found") > 0, "A?").otherwise("B"))


_AMOUNT = duck(PAGES)


@query(f"SELECT doc_id, list_sort(list_distinct([amount, replace(amount, '.', ','), {_amount('c', '.', ',')}, {_amount('c', ',', '.')}, replace({_amount('c', '.', ',')}, '.', ' ')] || CASE WHEN amount LIKE '%.00' THEN flatten(list_transform([replace(amount, '.00', ''), replace({_amount('c', '.', ',')}, ',00', ''), replace({_amount('c', ',', '.')}, '.00', ''), replace(replace({_amount('c', '.', ',')}, ',00', ''), '.', ' ')], lambda g: [g, g || ',-', g || '.-'])) ELSE [] END)) AS forms FROM (SELECT *, CAST(replace(amount, '.', '') AS BIGINT) AS c FROM ({_AMOUNT}))")
def printed_money_variants(spark, sf_dir):
    return frame(spark, sf_dir, PAGES).select("doc_id", F.array_sort(evidence.money_forms(F.col("amount"))).alias("forms"))


@query(f"SELECT doc_id, concat(substr(day, 9, 2), '.', substr(day, 6, 2), '.', substr(day, 1, 4)) AS german, concat(CAST(CAST(substr(day, 6, 2) AS INT) AS VARCHAR), '/', CAST(CAST(substr(day, 9, 2) AS INT) AS VARCHAR), '/', substr(day, 1, 4)) AS anglo FROM ({_AMOUNT})")
def printed_date_variants(spark, sf_dir):
    forms = evidence.date_forms(F.col("day"))
    pick = lambda text: F.try_element_at(F.filter(forms, lambda f: f == text), F.lit(1))
    y, m, d = (F.substring("day", *at) for at in ((1, 4), (6, 2), (9, 2)))
    german = F.concat(d, F.lit("."), m, F.lit("."), y)
    anglo = F.concat(F.regexp_replace(m, "^0", ""), F.lit("/"), F.regexp_replace(d, "^0", ""), F.lit("/"), y)
    return frame(spark, sf_dir, PAGES).select("doc_id", pick(german).alias("german"), pick(anglo).alias("anglo"))


@query("SELECT doc_id, min(item_id) AS item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) AND length(b.text) >= 4 GROUP BY 1")
def leak_scan(spark, sf_dir):
    """Reference passages printed inside texts."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return leaking.passages_in(docs, items.filter(F.length("text") >= 4), "doc_id", "text", "item_id", "text")
