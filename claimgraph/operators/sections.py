"""Sections of texts: where they stand, what changed, and where a quotation is found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sections(rows: DataFrame, key: str, text: str, separator: str = r"\n") -> DataFrame:
    """key, ordinal, text, char_start, char_end, digest: the pieces of each text between separators.

    Offsets count characters of the pieces, separators left out. A null text has no
    sections, an empty one has one. The running sum stays within a text's own array.
    """
    parts = F.split(F.col(text), separator)
    ends = F.aggregate(parts, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(x))))
    cut = rows.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.posexplode(F.arrays_zip(parts.alias("t"), F.slice(ends, F.lit(1), F.size(parts)).alias("a"))).alias("ordinal", "x"))
    piece, start = F.col("x")["t"], F.col("x")["a"]
    return cut.select(F.col("key").alias(key), "ordinal", piece.alias("text"), start.alias("char_start"), (start + F.length(piece)).alias("char_end"), F.md5(piece).alias("digest"))


def changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key, ordinal, change: 'created', 'updated' (another digest), 'deleted' or 'kept'."""
    joined = before.alias("b").join(after.alias("a"), F.expr(f"b.{key} = a.{key} AND b.ordinal = a.ordinal"), "full_outer")
    change = F.when(F.col("b.ordinal").isNull(), "created").when(F.col("a.ordinal").isNull(), "deleted").when(F.col("b.digest") != F.col("a.digest"), "updated").otherwise("kept")
    return joined.select(F.coalesce(f"b.{key}", f"a.{key}").alias(key), F.coalesce("b.ordinal", "a.ordinal").alias("ordinal"), change.alias("change"))


def located(text: Column, quote: Column, before: int = 80, size: int = 400) -> Column:
    """The text around the first place of the quotation, or null if it does not stand there."""
    at = F.instr(text, quote)
    return F.when(at > 0, F.substring(text, F.greatest(at - before, F.lit(1)), F.lit(size)))


def tightest(rows: DataFrame, key: str, text: str, words: str, run: int = 3) -> DataFrame:
    """key, start, span: the tightest stretch of a text that holds `run` words in a row of the array `words`.

    Positions are those of all occurrences; the span is between the first and the
    last of `run` neighbours in order, the earliest of equally tight ones.
    """
    spread = rows.select(F.col(key).alias("key"), F.lower(text).alias("t"), F.explode(F.array_distinct(F.transform(words, F.lower))).alias("w")).where("w <> ''")
    pieces = spread.select("key", "w", F.posexplode(F.expr(r"split(t, concat('\\Q', w, '\\E'))")).alias("i", "piece"))
    ordered = Window.partitionBy("key", "w").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = Window.partitionBy("key", "w").orderBy(F.col("i").desc())
    at = pieces.withColumns({"pos": F.sum(F.length("piece")).over(ordered) + F.col("i") * F.length("w"), "back": F.row_number().over(last)}).where("back > 1")
    near = Window.partitionBy("key").orderBy("pos", "w")
    spans = at.select("key", "pos", (F.lead("pos", run - 1).over(near) - F.col("pos")).alias("span")).where("span IS NOT NULL")
    best = spans.groupBy("key").agg(F.min(F.struct("span", "pos")).alias("b"))
    return best.select(F.col("key").alias(key), F.col("b.pos").alias("start"), F.col("b.span").alias("span"))
