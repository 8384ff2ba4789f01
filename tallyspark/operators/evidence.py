"""Printed evidence: whether a stored value stands on a page, in any form in which pages print it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import normalize
from ..functions.unicode import let, nullif_empty, strip, unicode_fold

# Typographic characters and what they are folded to; the last two go.
FOLD_FROM = "    ‐‑‒–—−‘’“”​­"
FOLD_TO = "    ------''\"\""

# Month names in German and English by number.
MONTH_NAMES = [
    ("Januar", "Jan", "January"), ("Februar", "Feb", "February"), ("März", "Maerz", "Mrz", "Mär", "March", "Mar"), ("April", "Apr"),
    ("Mai", "May"), ("Juni", "Jun", "June"), ("Juli", "Jul", "July"), ("August", "Aug"), ("September", "Sep", "Sept"),
    ("Oktober", "Okt", "October", "Oct"), ("November", "Nov"), ("Dezember", "Dez", "December", "Dec"),
]

# Signs for currencies.
CURRENCY_SIGNS = {"EUR": ["€"], "USD": ["$"], "GBP": ["£"], "CHF": ["SFr.", "Fr."]}

#: Shorter matches prove nothing.
STRONG = 4
POLICIES = {"STRING": "text", "CODE": "code", "MONEY": "money", "DATE": "date", "RATE": "rate"}


def fold(text: Column, unicode: bool = True) -> Column:
    folded = unicode_fold(text, "NFKC") if unicode else text
    return F.translate(folded, FOLD_FROM, FOLD_TO)


def casefolded(text: Column, unicode: bool = True) -> Column:
    return unicode_fold(text, "NFC", casefold=True) if unicode else F.lower(text)


def collapsed(text: Column, unicode: bool = True) -> Column:
    return strip(F.regexp_replace(casefolded(fold(text, unicode), unicode), r"\s+", " "))


def dense(text: Column, unicode: bool = True) -> Column:
    return F.regexp_replace(casefolded(fold(text, unicode), unicode), r"\s+", "")


def money_forms(canonical: Column) -> Column:
    """Every print of an amount: four ways to group and mark, whole amounts in short, with and without a sign."""
    return let(canonical, _money_forms)


def _money_forms(canonical: Column) -> Column:
    whole = F.regexp_extract(canonical, r"^-?(\d+)", 1)
    cents = F.coalesce(nullif_empty(F.regexp_extract(canonical, r"\.(\d+)$", 1)), F.lit("00"))
    grouped = {mark: normalize.group_thousands(whole, mark) if mark else whole for mark in (".", ",", " ", "")}
    plain = F.array(*(F.concat(grouped[g], F.lit(m), cents) for g, m in ((".", ","), (",", "."), (" ", ","), ("", ","), ("", "."))))
    short = F.array(*(F.concat(g, F.lit(end)) for g in grouped.values() for end in ("", ",-", ".-")))
    forms = F.when(cents == "00", F.concat(plain, short)).otherwise(plain)
    signed = lambda f: F.concat(f, F.transform(f, lambda x: F.concat(F.lit("-"), x)), F.transform(f, lambda x: F.concat(F.lit("("), x, F.lit(")"))))
    return F.array_distinct(let(forms, lambda f: F.when(canonical.startswith("-"), signed(f)).otherwise(f)))


def date_forms(iso: Column) -> Column:
    """Every print of a day: both orders of day and month, short forms, and names of months."""
    return let(iso, _date_forms)


def _date_forms(iso: Column) -> Column:
    y, m, d = (F.substring(iso, *at) for at in ((1, 4), (6, 2), (9, 2)))
    d1, m1 = F.regexp_replace(d, "^0", ""), F.regexp_replace(m, "^0", "")
    forms = [iso, F.concat(d, F.lit("."), m, F.lit("."))]
    for mark in (".", "/", "-"):
        s = F.lit(mark)
        forms += [F.concat(d, s, m, s, y), F.concat(d1, s, m1, s, y), F.concat(m, s, d, s, y), F.concat(m1, s, d1, s, y), F.concat(d, s, m, s, F.substring(iso, 3, 2))]
    names = F.try_element_at(F.array(*(F.array(*map(F.lit, n)) for n in MONTH_NAMES)), m.try_cast("int"))
    ways = (lambda n: F.concat(d, F.lit(". "), n, F.lit(" "), y), lambda n: F.concat(d1, F.lit(". "), n, F.lit(" "), y), lambda n: F.concat(d1, F.lit(" "), n, F.lit(" "), y), lambda n: F.concat(n, F.lit(" "), d1, F.lit(", "), y), lambda n: F.concat(n, F.lit(" "), d, F.lit(", "), y), lambda n: F.concat(n, F.lit(" "), d1, F.lit(" "), y))
    named = F.concat(*(F.transform(names, way) for way in ways))
    return F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.array_distinct(F.concat(F.array(*forms), named)))


def rate_forms(canonical: Column) -> Column:
    """Every print of a rate: none to two places, comma or point, with and without a percent sign."""
    return let(canonical.try_cast("double"), _rate_forms)


def _rate_forms(number: Column) -> Column:
    bases = F.array_distinct(F.flatten(F.array(*(F.array(t, F.translate(t, ".", ",")) for t in (F.format_string(f"%.{k}f", number) for k in range(3))))))
    marked = lambda end: F.transform(bases, lambda b: F.concat(b, F.lit(end)))
    return F.when(number.isNotNull(), F.concat(bases, marked("%"), marked(" %")))


def longest_printed(needles: Column, haystack: Column) -> Column:
    """The longest of ``needles`` that the dense ``haystack`` holds."""
    flat = lambda n: F.regexp_replace(F.lower(n), r"\s+", "")
    held = F.filter(needles, lambda n: (flat(n) != "") & F.contains(haystack, flat(n)))
    return F.try_element_at(F.array_sort(held, lambda a, b: F.length(b) - F.length(a)), F.lit(1))


def check(value: Column, policy: Column, text: Column, unicode: bool = True) -> Column:
    """``struct(status, matched, weak)`` of a value against a page's text.

    ``text`` is null where a page has no text. A match is weak if it is short, or a rate without a sign.
    """
    one = F.struct(strip(value).alias("v"), policy.alias("policy"), text.isNull().alias("bare"), dense(text, unicode).alias("dense"), collapsed(text, unicode).alias("flat"), collapsed(strip(value), unicode).alias("needle"))
    return let(one, lambda x: let(_canonical(x), lambda c: let(_matched(x, c), lambda m: _verdict(x, c, m))))


def _canonical(x: Column) -> Column:
    return F.when(x.policy == "money", normalize.money(x.v)).when(x.policy == "date", normalize.date(x.v)).when(x.policy == "rate", normalize.rate(x.v))


def _matched(x: Column, canonical: Column) -> Column:
    signs = F.create_map(*(c for k, forms in CURRENCY_SIGNS.items() for c in (F.lit(k), F.array(*map(F.lit, forms)))))
    forms = F.when(x.policy == "money", _money_forms(canonical)).when(x.policy == "date", _date_forms(canonical)).when(x.policy == "rate", rate_forms(canonical))
    needles = F.when(x.policy == "code", F.concat(F.array(x.v), F.coalesce(signs[F.upper(x.v)], F.expr("CAST(array() AS array<string>)")))).otherwise(F.concat(forms, F.array(x.v)))
    return F.when(x.policy == "text", F.when(F.contains(x.flat, x.needle), x.v)).otherwise(longest_printed(needles, x.dense))


def _verdict(x: Column, canonical: Column, matched: Column) -> Column:
    short = F.length(F.regexp_replace(matched, r"\s+", "")) < STRONG
    status = (
        F.when(x.policy == "exempt", "exempt")
        .when(F.coalesce(x.v, F.lit("")) == "", "null_claim")
        .when(x.bare, "no_text_layer")
        .when(x.policy.isin("money", "date", "rate") & canonical.isNull(), "unparseable")
        .when(matched.isNotNull(), "found")
        .otherwise("not_found")
    )
    weak = F.when(x.policy == "rate", ~F.contains(matched, F.lit("%"))).when(x.policy == "text", F.lit(False)).otherwise(short)
    found = status == "found"
    return F.struct(status.alias("status"), F.when(found, matched).alias("matched"), F.coalesce(found & weak, F.lit(False)).alias("weak"))


def address_findable(text: Column, address: Column) -> Column:
    """Whether every part of an address of three characters or more stands in the text."""
    parts = F.filter(F.transform(F.split(address, ","), lambda p: F.lower(strip(p))), lambda p: F.length(p) >= 3)
    return (F.size(parts) > 0) & F.forall(parts, lambda p: F.contains(F.lower(text), p))
