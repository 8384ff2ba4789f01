"""Unicode forms, which Spark has no function for: one Arrow-batched function per form."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@cache
def _folder(form: str, casefold: bool):
    def one(s):
        if s is None:
            return None
        s = s if s.isascii() else unicodedata.normalize(form, s)
        return s.casefold() if casefold else s

    def run(texts):
        return texts.map(one, na_action="ignore")

    import pandas as pd

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")


def unicode_fold(text: Column, form: str = "NFC", casefold: bool = False) -> Column:
    """``text`` in a Unicode normal form, case-folded if asked; null stays null."""
    return _folder(form, casefold)(text)


@cache
def _list_folder(form: str):
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(lists: pa.Array) -> pa.Array:
        flat = lists.flatten()
        if pc.all(pc.string_is_ascii(flat)).as_py() in (True, None):
            return lists
        return pa.array([None if one is None else [s if s is None or s.isascii() else unicodedata.normalize(form, s) for s in one] for one in lists.to_pylist()], lists.type)

    run.__annotations__ = {"lists": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<string>")


def unicode_fold_all(texts: Column, form: str = "NFC") -> Column:
    """An array of texts, each in a Unicode normal form; batches of ASCII pass as they are."""
    return _list_folder(form)(texts)


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(text, r"^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+$", "")


def nullif_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))
