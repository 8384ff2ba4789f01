"""Queries on corpora: profiles, set operations, joins of pairs, splits and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profiling
from ..sources import files
from .catalog import query
from .inputs import table


@query("SELECT lang, count(n_chars) AS n, min(n_chars) AS least, round(avg(n_chars), 6) AS mean, median(n_chars) AS median, max(n_chars) AS most FROM documents GROUP BY 1")
def distribution_stats(spark, sf_dir):
    return profiling.distribution(table(spark, sf_dir, "documents"), "n_chars", "lang")


@query("SELECT CAST((n_chars >= 100)::INT + (n_chars >= 1000)::INT + (n_chars >= 10000)::INT AS INTEGER) AS bin, count(*) AS n FROM documents WHERE n_chars IS NOT NULL GROUP BY 1")
def binned_histogram(spark, sf_dir):
    return profiling.histogram(table(spark, sf_dir, "documents"), "n_chars", [100, 1000, 10000])


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 5")
def top_k_values(spark, sf_dir):
    return profiling.top_values(table(spark, sf_dir, "documents"), "source", 5)


@query("SELECT lang, round(avg(CASE WHEN coalesce(text, '') <> '' THEN 1.0 ELSE 0.0 END), 6) AS text, round(avg(CASE WHEN coalesce(source, '') <> '' THEN 1.0 ELSE 0.0 END), 6) AS source FROM documents GROUP BY 1")
def presence_rates(spark, sf_dir):
    return profiling.presence(table(spark, sf_dir, "documents"), ["text", "source"], "lang")


@query("SELECT count(DISTINCT doc_id) AS n_docs, count(DISTINCT lang) AS n_langs, count(DISTINCT source) AS n_sources FROM documents")
def distinct_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.countDistinct("doc_id").alias("n_docs"), F.countDistinct("lang").alias("n_langs"), F.countDistinct("source").alias("n_sources"))


@query("SELECT n_name, count(c_custkey) AS n FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey AND c_acctbal > 9000 GROUP BY 1")
def counts_over_domain(spark, sf_dir):
    nations = table(spark, sf_dir, "nation")
    rich = table(spark, sf_dir, "customer").filter("c_acctbal > 9000").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name")
    return profiling.counts_over(rich, "n_name", nations.select("n_name"))


@query("SELECT doc_id, n_alike FROM documents JOIN (SELECT md5(text) AS h, count(*) AS n_alike FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1) ON md5(text) = h")
def duplicated_names(spark, sf_dir):
    named = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.md5("text").alias("h"))
    return profiling.duplicated(named, "h").select("doc_id", "n_alike")


@query("SELECT CASE WHEN grouping(lang) = 1 THEN 'ALL' ELSE lang END AS lang, count(*) AS n, count(*) FILTER (labelled) AS labelled, count(*) FILTER (long) AS long FROM (SELECT lang, n_chars > 1000 AS long, doc_id IN (SELECT doc_id FROM labels) AS labelled FROM documents) d GROUP BY ROLLUP (d.lang)")
def coverage_rollup(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("labelled"))
    flagged = docs.join(labels, "doc_id", "left").select("lang", F.coalesce("labelled", F.lit(False)).alias("labelled"), (F.col("n_chars") > 1000).alias("long"))
    return profiling.coverage(flagged, ["labelled", "long"], "lang")


@query("SELECT count(*) AS n_known, count(*) FILTER (quality = 1 - toxic) AS n_alike, round(count(*) FILTER (quality = 1 - toxic) / count(*), 6) AS rate FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def route_agreement(spark, sf_dir):
    return profiling.agreement(table(spark, sf_dir, "labels").select("quality", (1 - F.col("toxic")).alias("other")), "quality", "other")


@query("SELECT 'semi' AS kind, count(*) AS n FROM documents SEMI JOIN labels USING (doc_id) UNION ALL SELECT 'anti', count(*) FROM documents ANTI JOIN labels USING (doc_id)")
def semi_anti_subset(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    counted = lambda how: docs.join(labels, "doc_id", f"left_{how}").agg(F.lit(how).alias("kind"), F.count("*").alias("n"))
    return counted("semi").unionByName(counted("anti"))


@query("SELECT key, a.n AS n_orders, b.n AS n_lines FROM (SELECT o_orderkey AS key, count(*) AS n FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1) a FULL JOIN (SELECT l_orderkey AS key, count(*) AS n FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY 1) b USING (key)")
def full_outer_pairs(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").filter("o_orderkey % 3 <> 0").groupBy(F.col("o_orderkey").alias("key")).agg(F.count("*").alias("n_orders"))
    lines = table(spark, sf_dir, "lineitem").filter("l_orderkey % 5 <> 0").groupBy(F.col("l_orderkey").alias("key")).agg(F.count("*").alias("n_lines"))
    return orders.join(lines, "key", "full_outer")


@query("(SELECT o_custkey AS key, 'both' AS side FROM orders INTERSECT SELECT c_custkey, 'both' FROM customer WHERE c_acctbal > 0) UNION ALL (SELECT c_custkey, 'never' FROM customer EXCEPT SELECT o_custkey, 'never' FROM orders)")
def set_ops(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"))
    customers = table(spark, sf_dir, "customer")
    both = orders.intersect(customers.filter("c_acctbal > 0").select("c_custkey")).withColumn("side", F.lit("both"))
    return both.unionByName(profiling.unknown(customers.select(F.col("c_custkey").alias("key")), orders, "key").withColumn("side", F.lit("never")))


@query("SELECT doc_id, lang, source, CASE WHEN row_number() OVER (PARTITION BY lang, source ORDER BY sha256(concat(CAST(doc_id AS VARCHAR), '/7')), doc_id) <= round_even(0.2 * count(*) OVER (PARTITION BY lang, source), 0) THEN 'val' ELSE 'train' END AS side FROM documents")
def stratified_split(spark, sf_dir):
    return profiling.seal_split(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id", ["lang", "source"], 0.2, 7)


@query("SELECT lang, sha256(string_agg(CAST(doc_id AS VARCHAR), chr(10) ORDER BY CAST(doc_id AS VARCHAR))) AS fingerprint FROM documents GROUP BY 1")
def split_fingerprint(spark, sf_dir):
    return profiling.fingerprint(table(spark, sf_dir, "documents"), "doc_id", "lang")


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents) WHERE r IN (SELECT unnest([floor(k * n / 4) for k in range(4)]))")
def spread_sample(spark, sf_dir):
    return profiling.spread_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "lang", 4)


@query()
def file_manifest(spark, sf_dir):
    return files.manifest(files.walk(spark, sf_dir, content=True))
