"""Text of readers and pages: pages, markup, repeated lines, labelled values, totals."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .unicode import nullif_empty, strip, unicode_fold

# The mark of a page in a transcript, tokens that chat models leave in a text, element names of
# document markup, and cell marks of table markup.
PAGE_MARK = r"(?m)^={5}\s+PAGE\s+\d+\s+={5}\s*$"
CHAT_TOKENS = ["<|im_end|>", "<|im_start|>", "<|endoftext|>", "<|end|>", "<eos>", "<bos>", "<|user|>", "<|assistant|>", "<|system|>"]
MARKUP = "doctag text page_header page_footer otsl list_item caption picture table code chart formula section_header footnote paragraph title smiles inline".split()
CELL_MARKS = ["fcel", "lcel", "ecel", "ched", "rhed", "srow"]


def pages(body: Column) -> Column:
    """The pages of a transcript, trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(body, PAGE_MARK), strip), lambda p: p != "")


def header(text: Column, key: str) -> Column:
    return nullif_empty(F.regexp_extract(text, rf"(?m)^# {re.escape(key)}:\s+(.+)$", 1))


def strip_markup(text: Column) -> Column:
    """Without the tags of document markup and location tokens; other tags are text."""
    return F.regexp_replace(text, rf"<(?:/?(?:{'|'.join(MARKUP)})|loc_\d+)>", "")


def strip_chat_tokens(text: Column) -> Column:
    return F.regexp_replace(text, "|".join(map(re.escape, CHAT_TOKENS)), "")


def collapse_blank_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def collapse_line_runs(text: Column) -> Column:
    """Runs of three equal lines or more as one line; runs of two stay. One pass, each line beside its neighbours."""

    def stays(lines: Column) -> Column:
        near = lambda line, k: F.coalesce(F.get(lines, k) == line, F.lit(False))
        return F.filter(lines, lambda line, i: ~near(line, i - 1) | (~near(line, i - 2) & ~near(line, i + 1)))

    return F.array_join(F.element_at(F.transform(F.array(F.split(text, "\n")), stays), 1), "\n")


def collapse_blocks(text: Column, shortest: int = 3, longest: int = 15, copies: int = 3) -> Column:
    """Blocks of lines that follow themselves, ``copies`` times in all or more, as one block.

    Block lengths are tried from the shortest; the first at which something collapses is the last.
    """
    import pandas as pd

    def one(whole: str) -> str:
        lines = whole.split("\n")
        for size in range(shortest, longest + 1):
            # How many lines from each on equal the line a block later.
            alike = [0] * (len(lines) + 1)
            for i in range(len(lines) - size - 1, -1, -1):
                alike[i] = alike[i + 1] + 1 if lines[i] == lines[i + size] else 0
            out, i = [], 0
            while i < len(lines):
                if alike[i] >= (copies - 1) * size:
                    out += lines[i : i + size]
                    i += size * (1 + alike[i] // size)
                else:
                    out.append(lines[i])
                    i += 1
            if len(out) < len(lines):
                return "\n".join(out)
        return whole

    def run(texts):
        return texts.map(one, na_action="ignore")

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(text)


def table_rows(text: Column) -> Column:
    """Cell markup to lines: two cells are a label and its value, others stand side by side; rows without cells go."""
    cells = lambda row: F.filter(F.transform(F.split(row, f"<(?:{'|'.join(CELL_MARKS)})>"), strip), lambda c: c != "")
    label = lambda c: strip(F.regexp_replace(c[0], ":+$", ""))
    row = lambda c: F.when(F.size(c) == 2, F.concat(label(c), F.lit(": "), c[1])).otherwise(F.concat_ws(" ", c))
    return F.array_join(F.transform(F.filter(F.transform(F.split(text, "<nl>"), cells), lambda c: F.size(c) > 0), row), "\n")


def label_pattern(label: str) -> str:
    """A Java pattern of a line that begins with ``label``, after list marks and emphasis, and gives a value.

    Blanks, colons and emphasis set the value off; neither they nor the value leave the line.
    """
    return rf"(?im)^[\t \-•*`_]*+{re.escape(label)}[\t :*`_]*+([^\n]*)$"


def labelled(text: Column, label: str) -> Column:
    """The value after ``label`` on the first line that begins with it, cleaned; null if there is none."""
    return clean_value(F.regexp_extract(text, label_pattern(label), 1))


# Names of models whose output is document markup, table cells or repeats itself.
READERS = {"markup": ["granite-docling", "smoldocling"], "cells": ["MinerU", "mineru"], "repeats": ["paligemma", "PaliGemma"]}


def passed_through(text: Column, nfc: bool = True) -> Column:
    """In normal form C, without chat tokens and runs of blank lines."""
    return collapse_blank_lines(strip_chat_tokens(unicode_fold(text, "NFC") if nfc else text))


def adapted(text: Column, model: Column, nfc: bool = True) -> Column:
    """A transcript as the kind of output of its reader asks for, and passed through.

    The normal form comes first, so that no Python function reads what a conditional one gives.
    """
    text = unicode_fold(text, "NFC") if nfc else text
    reads = {"markup": lambda t: collapse_line_runs(strip_markup(t)), "cells": table_rows, "repeats": collapse_blocks}
    out = text
    for kind, names in reversed(READERS.items()):
        named = F.reduce(F.array(*map(F.lit, names)), F.lit(False), lambda found, name: found | F.contains(model, name))
        out = F.when(named, reads[kind](text)).otherwise(out)
    return passed_through(out, nfc=False)


def cross_references(text: Column) -> tuple[Column, Column]:
    """Number and date of ``Nr. X vom Y``, null where there is none."""
    found = r"(?i)\bNr\.?[ \t]*(\S+)[ \t]+vom[ \t]+(\d{1,2}\.\d{1,2}\.\d{4})"
    return nullif_empty(F.regexp_extract(text, found, 1)), nullif_empty(F.regexp_extract(text, found, 2))


def named_in_section(text: Column, heading: str, label: str = "Name") -> Column:
    """The value of ``label`` below ``heading`` and before the next blank line; null if there is none."""
    section = F.regexp_extract(text, rf"(?ims)^[\t *#_]*{re.escape(heading)}[^\n]*\n(.*?)(?:\n[\t ]*\n|\z)", 1)
    return labelled(section, label)


def window_lines(window: Column) -> Column:
    """The lines of a window, trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(window, "\n"), strip), lambda x: x != "")


def first_amount_of(window: Column, labels: list[str]) -> Column:
    """The amount after the first of ``labels``, by priority, that has one."""
    return F.coalesce(*(amount_after(window, label) for label in labels))


# What stands for no value on a page.
ABSENCE = ["[Name fehlt]", "[ID fehlt]", "[Adresse fehlt]", "[unable to determine]", "[unknown]", "[fehlt]", "[missing]", "[N/A]", "N/A", "Sorry, as a base VLM"]


def says_absent(text: Column) -> Column:
    """Whether a value is blank or says that there is none."""
    low = F.lower(text)
    return F.reduce(F.array(*(F.lit(mark.lower()) for mark in ABSENCE)), strip(text) == "", lambda found, mark: found | low.contains(mark))


def clean_value(text: Column) -> Column:
    """Without emphasis, framing marks and end marks; null if no letter or digit is left or it says that there is no value."""
    bare = strip(F.regexp_replace(strip(text), r"^[*`_]+\s*|\s*[*`_]+$", ""))
    bare = F.regexp_replace(strip(F.regexp_replace(bare, r"^[/:-]+", "")), r"[.,;:]+$", "")
    return F.when(bare.rlike(r"[\p{L}\p{N}]") & ~says_absent(bare), bare)


def totals_window(text: Column, start: str = "Belegsummen", end: str = "Zahlungsbedingung") -> Column:
    """The text from the heading of totals to that of payment terms, or to the end."""
    return nullif_empty(F.regexp_extract(text, rf"(?is)({start}.*?)(?:{end}|\z)", 1))


def amount_after(window: Column, label: str) -> Column:
    """The first German amount after ``label``, on its line or else the next that is not empty."""
    return nullif_empty(F.regexp_extract(window, rf"(?im)^.*?{re.escape(label)}[^\n\d-]*?(?:\n\s*)*?[^\n\d-]*(-?\d{{1,3}}(?:\.\d{{3}})*,\d{{2}})", 1))


def language_hits(text: Column, words: list[str]) -> Column:
    """How many of ``words`` the text holds."""
    return F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(text), w))).cast("long")


# Profiles by words of a file name or stem, in order of precedence.
NAME_PROFILES = {"BASICWL": "BASIC[ _-]?WL", "MINIMUM": "MINIMUM", "BASIC": "BASIC", "EN16931": "EN_?16931", "EXTENDED": "EXTENDED|ERWEITERT", "XRECHNUNG": "XRECHNUNG"}
STEM_PROFILES = ["EN16931", "XRECHNUNG", "EXTENDED", "BASICWL", "BASIC", "MINIMUM", "COMFORT"]


def profile_of_prefix(stem: Column) -> Column:
    """The profile that a stem begins with."""
    return F.when(stem.startswith("EN16931_"), "EN16931").when(stem.startswith("XRECHNUNG_"), "XRECHNUNG").otherwise("UNKNOWN")


def profile_of_name(name: Column) -> Column:
    """The first profile whose word stands alone in a file name; null if none does."""
    alone = lambda words: name.rlike(rf"(?i)(?<![^_/-])(?:{words})(?![^_/.-])")
    return F.coalesce(*(F.when(alone(words), F.lit(profile)) for profile, words in NAME_PROFILES.items()))


def profile_of_stem(stem: Column) -> Column:
    """The first profile that a stem holds anywhere, in any case of letters."""
    return F.coalesce(*(F.when(F.upper(stem).contains(tag), F.lit(tag)) for tag in STEM_PROFILES), F.lit("OTHER"))


def shown_amount(value: Column, currency: Column) -> Column:
    """An amount with separators of thousands, two places and its currency; what is no number stays as it is."""
    number = value.try_cast("double")
    return F.concat_ws(" ", F.coalesce(F.format_number(number, 2), value), currency)


def context_window(text: Column, needle: Column, reach: int = 40) -> Column:
    """The text around the first place of ``needle``, blanks collapsed, marked where it is cut; null without one."""
    flat = strip(F.regexp_replace(text, r"\s+", " "))
    at = F.instr(F.lower(flat), F.lower(needle))
    start = F.greatest(at - 1 - reach, F.lit(0))
    end = F.least(F.length(flat), at - 1 + F.length(needle) + reach)
    part = F.substring(flat, start + 1, end - start)
    return F.when((at > 0) & (needle != ""), F.concat(F.when(start > 0, "…").otherwise(""), part, F.when(end < F.length(flat), "…").otherwise("")))


def plain_form(text: Column) -> Column:
    """Lower case, without emphasis, umlauts spelled out, blanks collapsed: how answers are looked for."""
    low = F.regexp_replace(F.lower(text), "[*`]+", "")
    for letter, spelled in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        low = F.replace(low, F.lit(letter), F.lit(spelled))
    return strip(F.regexp_replace(low, r"\s+", " "))


def answer_forms(value: Column) -> Column:
    """The plain forms in which a page may print a stored value: amounts grouped either way, dates in four
    orders, account numbers in groups of four."""
    v = strip(value)
    day = v.rlike(r"^\d{4}-\d\d-\d\d$")
    y, m, d = F.substring(v, 1, 4), F.substring(v, 6, 2), F.substring(v, 9, 2)
    short = lambda part: part.cast("int").cast("string")
    dates = F.array(F.concat_ws(".", d, m, y), F.concat_ws(".", short(d), short(m), y), F.concat_ws("/", d, m, y), F.concat_ws("/", m, d, y))
    amount = v.rlike(r"^-?\d+\.\d\d$")
    whole, cents = F.substring_index(v, ".", 1), F.substring_index(v, ".", -1)
    grouped = lambda mark: F.regexp_replace(whole, r"(?<=\d)(?=(\d{3})+$)", mark)
    amounts = F.array(F.concat_ws(",", whole, cents), F.concat_ws(",", grouped("."), cents), F.concat_ws(".", grouped(","), cents))
    bare = F.replace(v, F.lit(" "), F.lit(""))
    account = bare.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9]{11,30}$")
    accounts = F.array(bare, F.regexp_replace(bare, r"(.{4})(?=.)", "$1 "))
    none = F.expr("CAST(array() AS array<string>)")
    forms = F.concat(F.array(v), F.when(day, dates).otherwise(none), F.when(amount, amounts).otherwise(none), F.when(account, accounts).otherwise(none))
    return F.when(v != "", F.array_distinct(F.transform(forms, plain_form)))
