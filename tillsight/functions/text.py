"""Text column builders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the characters counted as white space, as a class body that
# Java and RE2 read the same way.
SPACE = r"\t-\r\x1c-\x1f \x{85}\p{Z}"


def strip(x: Column) -> Column:
    """White space off both ends; a text with none there is not searched through."""
    ends = F.concat(F.left(x, F.lit(1)), F.right(x, F.lit(1)))
    return F.when(ends.rlike(f"[{SPACE}]"), F.regexp_replace(x, rf"^[{SPACE}]+|[{SPACE}]+$", "")).otherwise(x)


def full_text(title: Column, review: Column) -> Column:
    return strip(F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(review, F.lit(""))))


def sentences(text: Column) -> Column:
    """Split after . ! or ? followed by white space, dropping empty pieces.

    Pieces of a stripped text have no white space at their ends.
    """
    return F.filter(F.split(strip(text), rf"(?<=[.!?])[{SPACE}]+"), lambda s: s != "")


def word_pieces(text: Column) -> Column:
    """Lower-case runs of letters and digits, empty ones where the text begins or ends with none."""
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(word_pieces(text), lambda w: w != "")


def exploded(df: DataFrame, pieces: Column, name: str, *keep: str) -> DataFrame:
    """A row for each piece, none of which is null.

    A plain explode gets a filter on the size of its array, for which every
    text would be split a second time.
    """
    return df.select(*keep, F.explode_outer(pieces).alias(name)).where(F.col(name).isNotNull())


def non_ascii_share(x: Column) -> Column:
    n = F.length(x)
    return F.when(n > 0, F.length(F.regexp_replace(x, r"[\x00-\x7F]+", "")) / n).otherwise(0.0)


def split_phrases(x: Column, separator: str = " | ") -> Column:
    """Split on a literal separator (never as a regular expression)."""
    return F.split(x, "\\Q" + separator + "\\E")
