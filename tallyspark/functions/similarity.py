"""Normalised edit similarity of strings, by code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nls(a: Column, b: Column) -> Column:
    """1 less the edit distance in shares of the longer string; equal strings, empty ones too, give 1."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, F.lit(1.0)).otherwise(F.lit(1.0) - F.levenshtein(a, b) / longer)


def anls(a: Column, b: Column, threshold: Column | float) -> Column:
    """The similarity where it reaches ``threshold``, else 0."""
    value = nls(a, b)
    return F.when(value >= threshold, value).otherwise(F.lit(0.0))


def image_tokens(width: Column, height: Column, patch: int = 28) -> Column:
    return (F.ceil(width / patch) * F.ceil(height / patch)).cast("long")


def tile_plan(width: Column, height: Column, aspect: float = 2.0, target: float = 1.3, overlap: float = 0.12) -> Column:
    """Boxes that cover a tall page from top to bottom with some overlap; the page itself where it is not tall."""
    tile = F.ceil(width * target).cast("long")
    step = F.floor(tile * (1 - overlap)).cast("long")
    n = F.greatest(F.ceil((height - tile) / step).cast("long"), F.lit(0)) + 1
    box = lambda i: F.struct(F.lit(0).cast("long").alias("x0"), F.least(i * step, F.greatest(height - tile, F.lit(0))).cast("long").alias("y0"), width.cast("long").alias("x1"), F.least(F.least(i * step, F.greatest(height - tile, F.lit(0))) + tile, height).cast("long").alias("y1"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("x0"), F.lit(0).cast("long").alias("y0"), width.cast("long").alias("x1"), height.cast("long").alias("y1")))
    return F.when(height <= width * aspect, whole).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), box))


def fits_image(width: Column, height: Column, max_edge: int, max_tokens: int, patch: int = 28) -> Column:
    """Whether an image, rounded up to whole patches, stays within an edge and a number of tokens."""
    up = lambda x: F.ceil(x / patch).cast("long")
    return (up(width) * patch <= max_edge) & (up(height) * patch <= max_edge) & (up(width) * up(height) <= max_tokens)


def resized(width: Column, height: Column, max_edge: int, max_tokens: int, patch: int = 28, rounds: int = 20) -> Column:
    """``width`` and ``height`` of the largest image of the same shape that fits, by halving the long edge's range.

    An image that fits stays as it is. The short edge is rounded half to even, 1 at least. ``rounds`` halvings
    settle edges below 2 ** rounds.
    """
    long_edge, ratio = F.greatest(width, height).cast("long"), F.greatest(width, height) / F.least(width, height)
    short = lambda edge: F.greatest(F.bround(edge / ratio, 0).cast("long"), F.lit(1).cast("long"))

    def halve(r: Column, _: Column) -> Column:
        middle = F.floor((r.low + r.high) / 2).cast("long")
        fits = fits_image(middle, short(middle), max_edge, max_tokens, patch)
        done = r.low + 1 >= r.high
        return F.struct(F.when(~done & fits, middle).otherwise(r.low).alias("low"), F.when(~done & ~fits, middle).otherwise(r.high).alias("high"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(F.lit(1).cast("long").alias("low"), long_edge.alias("high")), halve).low
    wide = width >= height
    smaller = F.struct(F.when(wide, found).otherwise(short(found)).alias("width"), F.when(wide, short(found)).otherwise(found).alias("height"))
    same = F.struct(width.cast("long").alias("width"), height.cast("long").alias("height"))
    return F.when(fits_image(width, height, max_edge, max_tokens, patch), same).otherwise(smaller)


def is_blank_page(dark: Column, pixels: Column, least: float = 0.005) -> Column:
    """Whether a page is blank by its share of dark pixels."""
    return F.try_divide(dark, pixels) < least
