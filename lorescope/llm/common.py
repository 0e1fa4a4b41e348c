"""Helpers that several corpus operators share."""

from pyspark.sql import Column, DataFrame, functions as F

from lorescope.operators.joins import prefix_sums, settled, small_or_not, with_totals
from lorescope.sources.shared import shared_dir

__all__ = ["SPACE", "WORD", "count_of", "n_words", "prefix_sums", "sampled", "settled", "shared_dir", "small_or_not", "text_or_empty", "with_totals"]

#: A word: a maximal run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def count_of(text: Column, characters: str) -> Column:
    """How many of these characters a text has."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def sampled(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """About `rows` rows, chosen by a hash of the keys so that reruns choose the same ones; all if there
    are fewer. With the text among the keys, rows without an id or with a common one don't come all together."""
    n = df.count()
    return df if n <= rows else df.filter(F.pmod(F.xxhash64(*keys), F.lit(n)) < rows)
