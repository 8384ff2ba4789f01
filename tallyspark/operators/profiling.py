"""Corpus profiles: distributions, histograms, presence, coverage, duplicates, vocabularies; and sealed splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import ranked
from .scoring import count_if


def distribution(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Count, least, mean, median and greatest of a number; the median is exact."""
    v = F.col(value)
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.min(v).alias("least"), F.round(F.avg(v), 6).alias("mean"), F.median(v).alias("median"), F.max(v).alias("most"))


def histogram(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """Counts between edges, each bin closed below; numbers outside are in bins of their own."""
    bin_ = sum((F.col(value) >= e).cast("int") for e in edges)
    return df.filter(F.col(value).isNotNull()).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))


def top_values(df: DataFrame, value: str, k: int) -> DataFrame:
    """The ``k`` commonest values; ties by value."""
    return df.groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n"), value).limit(k)


def presence(df: DataFrame, columns: list[str], *by: str) -> DataFrame:
    """The share of rows in which each column says something."""
    return df.groupBy(*by).agg(*(F.round(F.avg(F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", 1.0).otherwise(0.0)), 6).alias(c) for c in columns))


def counts_over(df: DataFrame, value: str, domain: DataFrame) -> DataFrame:
    """A count for each value of ``domain``, zeros included."""
    return domain.join(df.groupBy(value).agg(F.count("*").alias("n")), value, "left").select(value, F.coalesce("n", F.lit(0)).alias("n"))


def duplicated(df: DataFrame, name: str) -> DataFrame:
    """All rows whose name is borne by another."""
    shared = df.groupBy(name).agg(F.count("*").alias("n_alike")).filter("n_alike > 1")
    return df.join(shared, name)


def coverage(df: DataFrame, flags: list[str], by: str, total: str = "ALL") -> DataFrame:
    """How many rows have each flag, by group and in all."""
    sums = df.rollup(by).agg(F.count("*").alias("n"), *(count_if(F.col(f)).alias(f) for f in flags), F.grouping(by).alias("all_of_them"))
    return sums.withColumn(by, F.when(F.col("all_of_them") == 1, total).otherwise(F.col(by))).drop("all_of_them")


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """How often two labels agree where both are known."""
    known = F.col(a).isNotNull() & F.col(b).isNotNull()
    sums = df.agg(count_if(known).alias("n_known"), count_if(known & (F.col(a) == F.col(b))).alias("n_alike"))
    return sums.withColumn("rate", F.round(F.coalesce(F.try_divide("n_alike", "n_known"), F.lit(0.0)), 6))


def unknown(wanted: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return wanted.select(key).distinct().join(known.select(key), key, "left_anti")


def fingerprint(df: DataFrame, name: str, *by: str) -> DataFrame:
    """SHA-256 of a side's names in order, one to a line; nulls go, and no rows give no fingerprint.

    The hash is sequential by its law, so a side passes one task, sorted with spilling and read as a stream.
    """
    keys = [f"k{i}" for i in range(len(by))]
    named = df.select(F.struct(F.lit(0), *(F.col(b).alias(k) for b, k in zip(by, keys))).alias("side"), F.col(name).cast("string").alias("name"))
    streamed = named.repartition("side").sortWithinPartitions("side", "name").mapInArrow(_digests, f"side {named.schema['side'].dataType.simpleString()}, fingerprint string")
    return streamed.select(*(F.col(f"side.{k}").alias(b) for b, k in zip(by, keys)), "fingerprint")


def _digests(batches):
    """The digest of each run of rows of one side."""
    import hashlib

    import pyarrow as pa

    def row(side, digest):
        return pa.RecordBatch.from_arrays([side, pa.array([digest.hexdigest()])], ["side", "fingerprint"])

    last, digest, begun = None, None, False
    for batch in batches:
        sides, names = batch.column(0), batch.column(1).to_pylist()
        for i, (side, name) in enumerate(zip(sides.to_pylist(), names)):
            if digest is None or side != last.to_pylist()[0]:
                if digest is not None:
                    yield row(last, digest)
                last, digest, begun = sides.slice(i, 1), hashlib.sha256(), False
            if name is not None:
                digest.update(("\n" * begun + name).encode())
                begun = True
    if digest is not None:
        yield row(last, digest)


def seal_split(df: DataFrame, key: str, strata: list[str], fraction: float, seed: int) -> DataFrame:
    """``side`` of each row: in every stratum the first share, rounded half to even, in an order by hash, is ``val``."""
    order = F.sha2(F.concat(F.col(key).cast("string"), F.lit(f"/{seed}")), 256)
    found = ranked(df, [F.col(s) for s in strata], [order, F.col(key)])
    return found.select("row.*", F.when(F.col("rank") < F.bround(F.col("size") * F.lit(fraction)), "val").otherwise("train").alias("side"))


def spread_sample(df: DataFrame, key: str, by: str, wanted: int) -> DataFrame:
    """``wanted`` rows of each group, evenly spread over its order of keys."""
    # Row r is taken if it is the floor of k * n / wanted for some k.
    k = F.ceil(F.col("rank") * wanted / F.col("size"))
    taken = (F.floor(k * F.col("size") / wanted) == F.col("rank")) & (k < wanted)
    return ranked(df, [F.col(by)], [F.col(key)]).filter(taken).select("row.*")


def stable_ids(items: DataFrame, known: DataFrame, key: str, prefix: Column) -> DataFrame:
    """Known items keep their id; new ones get the next free numbers under their prefix, in order of key."""
    number = F.regexp_extract("id", r"(\d+)$", 1).cast("long")
    used = known.groupBy(F.regexp_replace("id", r"\d+$", "").alias("prefix")).agg(F.max(number).alias("last"))
    joined = items.withColumn("prefix", prefix).join(known.select(key, "id"), key, "left").select(key, "prefix", "id")
    fresh = ranked(joined.filter("id IS NULL"), [F.col("prefix")], [F.col(key)]).select("row.*", "rank").join(used, "prefix", "left")
    nth = F.col("rank") + 1 + F.coalesce("last", F.lit(0))
    numbered = fresh.select(key, F.concat("prefix", F.lpad(nth.cast("string"), F.greatest(F.lit(3), F.length(nth.cast("string"))), F.lit("0"))).alias("id"))
    return joined.filter("id IS NOT NULL").select(key, "id").unionByName(numbered)
