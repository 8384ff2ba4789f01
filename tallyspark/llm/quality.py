"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import fresh

#: White space between words: blank and the characters 9 to 13.
BLANKS = " \t\n\x0b\x0c\r"
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a and as at be by for from have in is it of on or that the this to was with "
    "das dem den der des die ein eine im ist mit nicht und von zu "
    "au aux ce dans de des du en est et la le les ne pas pour que qui un une "
    "como con del el es las lo los no para por se su una y"
).split()

#: Base rule: fewer words, or a higher percentage of words in repeated 3-word windows, fails.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

#: The method's rules, as (name, measure, scale, by, low, high): low <= scale * measure / by <= high, in
#: whole numbers, so that no rounding decides. None: no bound.
RULES = [
    ("length", "n_words", 1, None, None, 100_000),
    ("word_length", "word_chars", 10, "n_words", 20, 120),
    ("symbol_ratio", "n_symbols", 100, "n_words", None, 10),
    ("stop_words", "n_stop_words", 100, "n_words", 2, None),
    ("duplicate_lines", "n_dup_lines", 100, "n_lines", None, 50),
]


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is so evaluated once for each row."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def word_array(text: str) -> str:
    """The words of ``text``: maximal runs of characters other than blanks; none for null."""
    return rf"filter(split(coalesce({text}, ''), '[ \\t-\\r]+'), x -> x <> '')"


def repeated_words(words: str, width: int = 3) -> str:
    """Words covered by windows of ``width`` words whose words are found twice or more in the array.

    The windows are sorted with their positions, so that equal ones are neighbours; no window is compared
    with all others, and a text of any length takes n log n steps.
    """
    parts = ", ".join(f"{words}[i + {k}]" for k in range(width))
    windows = f"array_sort(transform(sequence(0, size({words}) - {width}), i -> struct(concat_ws(' ', {parts}) AS t, i AS i)))"
    twice = "filter(s, (x, k) -> coalesce(get(s, k - 1).t = x.t, false) OR coalesce(get(s, k + 1).t = x.t, false))"
    covered = f"size(array_distinct(flatten(transform({twice}, x -> sequence(x.i, x.i + {width - 1})))))"
    return f"CASE WHEN size({words}) < {width} THEN 0 ELSE {_let(windows, 's', covered)} END"


def measures(text: str) -> Column:
    """One struct of all measures of ``text``."""
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    lines = rf"filter(split(coalesce({text}, ''), '\\n'), x -> translate(x, ' \t\x0b\x0c\r', '') <> '')".replace("\t", "\\t").replace("\x0b", "\\u000b").replace("\x0c", "\\u000c").replace("\r", "\\r")
    body = f"""named_struct(
        'n_words', cast(size(w) as bigint),
        'word_chars', cast(aggregate(w, 0, (n, x) -> n + length(x)) as bigint),
        'n_symbols', cast(length(coalesce({text}, '')) - length(translate(coalesce({text}, ''), '{SYMBOLS}', '')) as bigint),
        'n_stop_words', cast(size(filter(w, x -> x in ({stops}))) as bigint),
        'n_repeat_words', cast({repeated_words("w")} as bigint),
        'l', {_let(lines, "l", "struct(cast(size(l) as bigint) AS n, cast(size(l) - size(array_distinct(l)) as bigint) AS dup)")})"""
    return F.expr(_let(word_array(text), "w", body))


def base_failed(m: str) -> str:
    return f"({m}n_words < {MIN_WORDS} OR 100 * {m}n_repeat_words > {MAX_REPEAT_PERCENT} * {m}n_words)"


def rules_hold(m: str, rules: list[tuple] = RULES) -> str:
    """The table as one SQL condition over the measures, in whole numbers; the same text is valid in DuckDB."""
    terms = []
    for _, measure, scale, by, low, high in rules:
        per = f"{m}{by}" if by else "1"
        terms += [f"{scale} * {m}{measure} >= {low} * {per}"] * (low is not None)
        terms += [f"{scale} * {m}{measure} <= {high} * {per}"] * (high is not None)
    return "(" + " AND ".join(terms) + ")"


def quality_rules(docs: DataFrame, rules: list[tuple] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures and verdicts of every whole text: one projection, no shuffle.

    ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept``. A null text
    has no words and fails the base rule, as do empty and blank ones. Rows are judged one by one, so ties,
    repeated rows and null ids change nothing; an empty table gives no rows; other columns are ignored.
    """
    m = docs.select(F.col(id_col).cast("long").alias("doc_id"), measures(f"`{text_col}`").alias("m"))
    flat = m.select("doc_id", "m.n_words", "m.word_chars", "m.n_symbols", F.col("m.l.dup").alias("n_dup_lines"), "m.n_repeat_words", "m.n_stop_words", F.col("m.l.n").alias("n_lines"))
    return flat.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.expr(base_failed("")).alias("base_failed"),
        F.expr(f"NOT {base_failed('')} AND {rules_hold('', rules)}").alias("kept"),
    )


def keep_good(docs: DataFrame, rules: list[tuple] = RULES, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns unchanged, whatever their names.

    Null, empty and blank texts go; rows are judged one by one, so ties and repeated rows change nothing.
    """
    (name,) = fresh(docs, "measures")
    m = docs.withColumn(name, measures(f"`{text_col}`"))
    parts = [F.col(f"{name}.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_stop_words", "n_repeat_words")]
    flat = m.withColumn(name, F.struct(*parts, F.col(f"{name}.l.dup").alias("n_dup_lines"), F.col(f"{name}.l.n").alias("n_lines")))
    return flat.filter(F.expr(f"NOT {base_failed(name + '.')} AND {rules_hold(name + '.', rules)}")).drop(name)


#: The same in DuckDB.
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
t AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM t),
c AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
      CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
      CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
      CAST(len(list_filter(w, lambda x: x IN ({", ".join(f"'{w}'" for w in STOP_WORDS)}))) AS BIGINT) AS n_stop_words,
      CAST(len(l) AS BIGINT) AS n_lines
      FROM w LEFT JOIN c USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       {base_failed("")} AS base_failed, (NOT {base_failed("")} AND {rules_hold("")}) AS kept FROM m
"""
