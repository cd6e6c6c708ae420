"""Column expressions shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a longest run of characters other than these six.
SPACES = r"\x20\x09-\x0D"
WORD = rf"[^{SPACES}]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once per row.

    The optimizer may copy a projected column into every place that names it,
    also into lambdas that run once per word; a lambda variable stays one value.
    """
    return F.transform(F.array(value), body)[0]


def held(rows: DataFrame, condition: Column) -> DataFrame:
    """``rows`` where the condition holds, filtered where its columns have been computed.

    An ordinary filter on computed columns is pushed below their projection, and what they are made of is then
    worked out again for every use, word arrays inside lambdas even once per word. A filter that
    also names a row number stays above.
    """
    numbered = rows.withColumn("_row_number", F.monotonically_increasing_id())
    return numbered.where(condition & (F.col("_row_number") >= 0)).drop("_row_number")


def words(text: Column) -> Column:
    """The words of a text, unchanged and in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACES}]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def grams(tokens: Column, n: int) -> Column:
    """64-bit hashes of all n-token windows, in order of their first token."""
    if n == 1:
        return F.transform(tokens, lambda w: F.xxhash64(w))
    return longer_grams(grams(tokens, n - 1), tokens, n)


def longer_grams(shorter: Column, tokens: Column, n: int) -> Column:
    """Hashes of n-token windows from those of the (n-1)-token windows."""
    count = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    return F.zip_with(
        F.slice(shorter, F.lit(1), count), F.slice(tokens, F.lit(n), count), lambda h, w: F.xxhash64(h, w)
    )


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
