"""Inputs of the queries, derived from the driver's tables by SQL that Spark and DuckDB read alike.

Stored records are orders; what three models have read from them is a fixed distortion by order and model,
so every kind of outcome occurs. ``{name}`` stands for a table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of shared SQL in Spark."""
    names = set(re.findall(r"\{(\w+)\}", sql))
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def spread(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """``frame`` with its tables dealt out evenly, for work per row that the few splits of a small file cannot share."""
    names = set(re.findall(r"\{(\w+)\}", sql))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return spark.sql(sql, **{x: table(spark, sf_dir, x).repartition(n) for x in names})


def duck(sql: str) -> str:
    """Shared SQL as DuckDB reads it."""
    return re.sub(r"\{(\w+)\}", r"\1", sql)


_EUROS = "CAST(CAST(FLOOR({c} / 100) AS BIGINT) AS STRING)"
_CENTS = "lpad(CAST({c} % 100 AS STRING), 2, '0')"


def _amount(cents: str, group: str, mark: str) -> str:
    """Digits of an amount below a billion of cents, in groups of three."""
    head = f"CAST(CAST(FLOOR({cents} / 100000) AS BIGINT) AS STRING)"
    tail = f"lpad(CAST(CAST(FLOOR({cents} / 100) AS BIGINT) % 1000 AS STRING), 3, '0')"
    euros = f"CAST(CAST(FLOOR({cents} / 100) AS BIGINT) AS STRING)"
    whole = f"CASE WHEN {cents} >= 100000 THEN concat({head}, '{group}', {tail}) ELSE {euros} END" if group else euros
    return f"concat({whole}, '{mark}', lpad(CAST({cents} % 100 AS STRING), 2, '0'))"


#: One row for each model and order, with what the record holds and how the model distorts it.
READINGS = """
SELECT concat('model-', CAST(m AS STRING)) AS model_id, o_orderkey AS doc_id, o_orderpriority AS profile,
       CAST((o_orderkey * 7 + m) % 12 AS INT) AS k, CAST(ROUND(o_totalprice * 100) AS BIGINT) AS cents,
       CAST(CAST(o_orderdate AS DATE) AS STRING) AS day, c_name AS name, c_mktsegment AS segment
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
CROSS JOIN (SELECT 0 AS m UNION ALL SELECT 1 AS m UNION ALL SELECT 2 AS m) models
"""


def _field(key: str, kind: str, rule: str, group: str, present: str, gold: str, said: str) -> str:
    return f"""SELECT model_id, doc_id, profile, segment, '{key}' AS field_key, '{kind}' AS field_type, '{rule}' AS rule, '{group}' AS field_group,
       {present} AS gt_present, CASE WHEN {present} THEN {gold} END AS gt_norm, {said} AS pred_raw FROM readings"""


_DMY = "concat(substr(day, 9, 2), '{0}', substr(day, 6, 2), '{0}', substr(day, 1, 4))"
_MONEY = _amount("cents", "", ".")

#: The long table of cells: five fields for each model and order.
CELLS = f"""
WITH readings AS ({READINGS})
{_field("invoice_number", "CODE", "invoice_number", "", "true", "CASE WHEN doc_id % 23 = 0 THEN '' ELSE concat('RE-', CAST(doc_id AS STRING)) END",
        "CASE k WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN '' WHEN 4 THEN concat('RE-', CAST(doc_id AS STRING), 'X') WHEN 5 THEN concat('Rechnung Nr. RE-', CAST(doc_id AS STRING)) WHEN 6 THEN concat(' Nr.: RE-', CAST(doc_id AS STRING)) ELSE concat('RE-', CAST(doc_id AS STRING)) END")}
UNION ALL
{_field("issue_date", "DATE", "DATE", "", "true", "day",
        f"CASE k WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN '' WHEN 4 THEN '30.02.2023' WHEN 5 THEN {_DMY.format('/')} WHEN 7 THEN {_DMY.format('.')} WHEN 8 THEN 'unknown' ELSE day END")}
UNION ALL
{_field("grand_total_amount", "MONEY", "MONEY", "totals", "true", f"CASE WHEN doc_id % 17 <> 0 THEN {_MONEY} END",
        f"CASE k WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN '' WHEN 2 THEN concat({_amount('cents', '.', ',')}, ' EUR') WHEN 3 THEN concat('$', {_amount('cents', ',', '.')}) WHEN 4 THEN {_amount('(cents + 1)', '', '.')} WHEN 8 THEN 'n/a' ELSE {_MONEY} END")}
UNION ALL
{_field("buyer_name", "STRING", "STRING", "buyer", "(doc_id % 5 <> 0)", "name",
        "CASE k WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN '' WHEN 6 THEN replace(name, 'u', 'v') WHEN 7 THEN concat('  ', name, ' ') WHEN 8 THEN 'zzz' WHEN 9 THEN substr(name, 1, 9) ELSE name END")}
UNION ALL
{_field("buyer_reference", "CODE", "CODE", "buyer", "(doc_id % 3 <> 0)", "segment",
        "CASE k WHEN 0 THEN CAST(NULL AS STRING) WHEN 3 THEN lower(segment) ELSE segment END")}
"""


def _read(rule: str) -> str:
    """DuckDB's canonical form of ``pred_raw`` by a rule."""
    trimmed = "trim(pred_raw)"
    if rule == "MONEY":
        s = f"nullif(trim(regexp_replace({trimmed}, '(?i)EUR|USD|\\$', '', 'g')), '')"
        c, d = f"instr(reverse({s}), ',')", f"instr(reverse({s}), '.')"
        number = f"CASE WHEN {c} > 0 AND ({d} = 0 OR {c} < {d}) THEN replace(replace({s}, '.', ''), ',', '.') ELSE replace({s}, ',', '') END"
        return f"CAST(TRY_CAST({number} AS DECIMAL(38, 2)) AS VARCHAR)"
    if rule == "DATE":
        return f"strftime(coalesce(CASE WHEN regexp_full_match({trimmed}, '\\d{{4}}-\\d\\d-\\d\\d') THEN try_strptime({trimmed}, '%Y-%m-%d') END, CASE WHEN regexp_full_match({trimmed}, '\\d\\d[./]\\d\\d[./]\\d{{4}}') THEN try_strptime(replace({trimmed}, '/', '.'), '%d.%m.%Y') END), '%Y-%m-%d')"
    if rule == "invoice_number":
        return f"nullif(coalesce(nullif(trim(regexp_replace({trimmed}, '(?i)^\\s*(?:invoice\\s+|rechnungs?[-\\s]*)?(?:nr|no|nummer|number)(?:[.:#]+\\s*|\\s+)', '')), ''), {trimmed}), '')"
    return f"nullif({trimmed}, '')"


READ_SQL = f"""read AS (SELECT *, CASE rule {" ".join(f"WHEN '{r}' THEN {_read(r)}" for r in ("MONEY", "DATE", "invoice_number"))} ELSE {_read("STRING")} END AS pred_norm FROM cells),
likened AS (SELECT *, CASE WHEN field_type = 'STRING' AND gt_norm <> '' THEN CASE WHEN pred_norm = gt_norm THEN 1.0 ELSE 1.0 - CAST(levenshtein(pred_norm, gt_norm) AS DOUBLE) / greatest(length(pred_norm), length(gt_norm)) END END AS nls FROM read)"""


def judged(threshold: str = "0.5") -> str:
    return f"""SELECT *, CASE WHEN outcome = 'TN' THEN 1.0 WHEN gt_present AND gt_norm <> '' AND field_type = 'STRING' THEN coalesce(nls, 0.0) WHEN outcome = 'TP' THEN 1.0 ELSE 0.0 END AS score FROM
(SELECT *, CASE WHEN NOT gt_present THEN CASE WHEN pred_norm IS NULL THEN 'TN' ELSE 'FP' END WHEN gt_norm IS NULL THEN 'EXCLUDED'
  WHEN gt_norm = '' THEN CASE WHEN coalesce(pred_norm, '') = '' THEN 'TN' ELSE 'FN' END
  WHEN coalesce(CASE WHEN field_type = 'STRING' THEN nls >= {threshold} AND nls > 0 ELSE pred_norm = gt_norm END, false) THEN 'TP' ELSE 'FN' END AS outcome FROM likened) judged"""


def scored_sql(rest: str) -> str:
    """DuckDB SQL over ``scored``, the judged cells."""
    return f"WITH cells AS ({duck(CELLS)}), {READ_SQL}, scored AS ({judged()}) {rest}"


COUNTS_SQL = ", ".join(f"CAST(count(*) FILTER (outcome = '{o}') AS BIGINT) AS {o.lower()}" for o in ("TP", "FP", "FN"))


def ratio_sql(above: str, below: str) -> str:
    return f"round(coalesce(CAST({above} AS DOUBLE) / nullif({below}, 0), 0.0), 6)"


def f1_sql(tp: str = "tp", fp: str = "fp", fn: str = "fn", prefix: str = "") -> str:
    return f"{ratio_sql(tp, f'({tp} + {fp})')} AS {prefix}precision, {ratio_sql(tp, f'({tp} + {fn})')} AS {prefix}recall, {ratio_sql(f'2 * {tp}', f'(2 * {tp} + {fp} + {fn})')} AS {prefix}f1"
