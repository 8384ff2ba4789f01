"""Adjudication of one cell from several channels' readings, and what follows from the decisions.

Readings: ``doc_id, key, policy, ord`` (order of channels), ``channel, value`` (null: nothing found),
``covered`` (whether the channel could say), ``canonical`` (its form for comparison), and of the evidence
check ``proven``, ``weak`` and ``unparseable``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize
from ..functions.unicode import nullif_empty, strip
from .evidence import casefolded, fold
from .scoring import count_if

# Separators that two prints of one text may differ in.
SEPARATORS = " \t\r\n,.;:/\\|-–—_·•()[]"

#: Why a case goes to a person, most alarming first.
RANKS = ["asserted-unevidenced", "conflict-none-evidenced", "conflict-one-evidenced", "null-disputed", "weak-match", "unparseable", "exempt-vocabulary", "single-channel-proven", "nested-readings"]


def canonical_form(value: Column, policy: Column, unicode: bool = True) -> Column:
    """What two readings must share to say the same."""
    text = nullif_empty(strip(value))
    bare = casefolded(F.translate(fold(text, unicode), SEPARATORS, ""), unicode)
    typed = F.when(policy == "money", normalize.money(text)).when(policy == "date", normalize.date(text)).when(policy == "rate", normalize.rate(text)).when(policy == "code", normalize.code(text, nfc=unicode))
    return F.when(policy == "text", nullif_empty(bare)).otherwise(casefolded(F.coalesce(typed, F.regexp_replace(text, r"\s+", " ")), unicode))


def _first(array: Column) -> Column:
    return F.try_element_at(array, F.lit(1))


def _tokens(value: Column, unicode: bool = True) -> Column:
    folded = F.regexp_replace(casefolded(fold(F.coalesce(value, F.lit("")), unicode), unicode), "ß", "ss")
    spaced = F.translate(folded, SEPARATORS, " " * len(SEPARATORS))
    return F.array_distinct(F.filter(F.split(spaced, " "), lambda t: t != ""))


def _fullest(members: Column) -> Column:
    """The reading of agreeing members to keep: a printed one if any is, then the longest, then the first."""
    printed = F.filter(members, lambda r: r.proven)
    pool = F.when(F.size(printed) > 0, printed).otherwise(members)
    return _first(F.array_sort(pool, lambda a, b: F.when(F.length(a.value) != F.length(b.value), F.length(b.value) - F.length(a.value)).otherwise(a.ord - b.ord)))


def adjudicate(readings: DataFrame) -> DataFrame:
    """``doc_id, key, provenance, value, rank, n_agreeing`` of every cell; a null rank is accepted unseen.

    One grouping by cell; a cell has as many readings as there are channels.
    """
    row = F.struct("ord", "channel", "value", "covered", "canonical", "proven", "weak", "unparseable")
    cells = readings.groupBy("doc_id", "key", "policy").agg(F.array_sort(F.collect_list(row)).alias("rs"))
    said = F.filter("rs", lambda r: r.value.isNotNull())
    cells = cells.withColumns({"said": said, "silent": F.filter("rs", lambda r: r.covered & r.value.isNull()), "n_covered": F.size(F.filter("rs", lambda r: r.covered))})
    forms = F.array_distinct(F.transform(F.filter("said", lambda r: r.canonical.isNotNull()), lambda r: r.canonical))
    groups = F.transform(forms, lambda c: F.filter(F.col("said"), lambda r: r.canonical == c))
    cells = cells.withColumn("groups", groups)
    facts = F.transform("groups", lambda g: F.struct(F.size(g).alias("n"), F.exists(g, lambda r: r.proven).alias("proven"), _tokens(_first(g).value, unicode=False).alias("tokens"), _fullest(g).value.alias("best")))
    cells = cells.withColumn("facts", facts)
    proven = F.filter("facts", lambda f: f.proven)
    by_size = F.array_sort(F.col("facts"), lambda a, b: F.when(a.n != b.n, b.n - a.n).otherwise(F.size(b.tokens) - F.size(a.tokens)))
    widest = F.array_max(F.transform("facts", lambda f: f.n))
    host = _first(F.array_sort(F.col("facts"), lambda a, b: F.size(b.tokens) - F.size(a.tokens)))
    nested = F.forall("facts", lambda f: F.size(F.array_except(f.tokens, host.tokens)) == 0) & ((F.size(proven) == 0) | host.proven)
    cells = cells.withColumns({"proven_groups": proven, "plurality": _first(by_size), "widest": widest, "nested": nested, "any_weak": F.exists("said", lambda r: r.weak), "any_bad": F.exists("said", lambda r: r.unparseable)})
    winner, only = _first(F.col("proven_groups")), _first(F.col("facts"))
    refuted = (F.size("proven_groups") == 1) & (winner.n >= 2) & (winner.n >= F.col("widest"))

    def decide(provenance: str, value: Column | None = None, rank: int | None = None, agreeing: Column | None = None) -> Column:
        nothing = F.lit(None)
        return F.struct(
            F.lit(provenance).alias("provenance"),
            (nothing if value is None else value).cast("string").alias("value"),
            (nothing if rank is None else F.lit(rank)).cast("int").alias("rank"),
            (F.lit(0) if agreeing is None else agreeing).cast("int").alias("n_agreeing"),
        )

    author, proved, agreed = "author-adjudicated", "text-layer-proven", "two-channel-agreed"
    evidenced, two = only.proven, only.n >= 2
    decision = (
        F.when(F.size("said") == 0, F.when(F.col("n_covered") == 0, decide("null-claim", rank=1)).otherwise(decide("null-claim", agreeing=F.col("n_covered"))))
        .when((F.size("facts") > 1) & refuted, decide(proved, winner.best, agreeing=winner.n))
        .when((F.size("facts") > 1) & (F.col("policy") == "text") & F.col("nested"), decide(author, F.col("plurality.best"), 9, F.col("plurality.n")))
        .when((F.size("facts") > 1) & (F.size("proven_groups") == 1), decide(author, rank=3, agreeing=F.col("plurality.n")))
        .when(F.size("facts") > 1, decide(author, rank=2, agreeing=F.col("plurality.n")))
        .when(F.col("policy") == "exempt", F.when(two, decide(agreed, only.best, agreeing=only.n)).otherwise(decide("exempt-by-policy", only.best, 7, only.n)))
        .when(F.col("any_bad"), decide(author, only.best, 6, only.n))
        .when(evidenced & two, decide(proved, only.best, agreeing=only.n))
        .when(evidenced, decide(proved, only.best, 8, only.n))
        .when(two, decide(agreed, only.best, agreeing=only.n))
        .when(F.size("silent") > 0, decide(author, only.best, 4, only.n))
        .when(F.col("any_weak"), decide(author, only.best, 5, only.n))
        .otherwise(decide(author, only.best, 1, only.n))
    )
    return cells.select("doc_id", "key", decision.alias("d")).select("doc_id", "key", "d.*")


def decision_summary(decisions: DataFrame) -> DataFrame:
    """How many cells were accepted, escalated, and by what class and rank."""
    out = decisions.groupBy("provenance", "rank").agg(F.count("*").alias("n_cells"), count_if(F.col("rank").isNull()).alias("n_accepted"))
    return out.withColumn("label", F.try_element_at(F.array(*map(F.lit, RANKS)), F.col("rank")))


def promote(decisions: DataFrame, answers: DataFrame) -> DataFrame:
    """Accepted values, a person's answers where there are any, and null for cells still open.

    ``answers``: ``doc_id, key, answer``; an answer of null is an answer, a missing row is none.
    """
    asked = decisions.join(answers.withColumn("answered", F.lit(True)), ["doc_id", "key"], "left")
    accepted, answered = F.col("rank").isNull(), F.coalesce("answered", F.lit(False))
    return asked.select(
        "doc_id", "key",
        F.when(answered, F.col("answer")).when(accepted, F.col("value")).alias("value"),
        F.when(answered & ~accepted, F.lit("author-adjudicated")).otherwise(F.col("provenance")).alias("provenance"),
        (~accepted & ~answered).alias("pending"),
    )


def promotion_status(promoted: DataFrame) -> DataFrame:
    """Cells of each document and whether its record may count as verified: only when none is open."""
    return promoted.groupBy("doc_id").agg(F.count("*").alias("n_cells"), count_if(F.col("pending")).alias("n_pending")).withColumn("verified", F.col("n_pending") == 0)
