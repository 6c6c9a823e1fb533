"""Names grouped by first name and surname, and those that had better be held for a person to judge.

A plain grouping over the claim store; the linking of all variants is problem 5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Generations that are no part of a name, and degrees at its end.
GENERATIONS = ("jr", "sr", "ii", "iii", "iv")
DEGREE = r"(?i),?\s*(ph\.?\s*d\.?|esq(?:uire)?\.?|m\.?\s*d\.?|j\.?\s*d\.?|ed\.?\s*d\.?)\s*$"


def normalised(name: Column) -> Column:
    """Without a last parenthesis and degree, marks on letters dropped, hyphens tight, white space squeezed, lower case.

    Letters whose mark does not come apart (such as ø) stay as they are.
    """
    bare = F.regexp_replace(F.regexp_replace(name, r"\s*\([^)]*\)\s*$", ""), DEGREE, "")
    plain = F.translate(bare, "áàâäãåéèêëíìîïóòôöõúùûüñçÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ", "aaaaaaeeeeiiiiooooouuuuncAAAAAAEEEEIIIIOOOOOUUUUNC")
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(plain, r"\s*-\s*", "-"), r"\s+", " ")))


def tokens(norm: Column) -> Column:
    return F.filter(F.split(norm, " "), lambda t: ~F.replace(t, F.lit(".")).isin(*GENERATIONS) & (t != ""))


def signature(norm: Column) -> Column:
    """struct(first, middle, surname) of a normalised name, middle as initials; null for a single word."""
    t = tokens(norm)
    middle = F.array_join(F.transform(F.slice(t, 2, F.greatest(F.size(t) - 2, F.lit(0))), lambda x: F.left(x, F.lit(1))), " ")
    return F.when(F.size(t) >= 2, F.struct(F.get(t, F.lit(0)).alias("first"), middle.alias("middle"), F.element_at(t, -1).alias("surname")))


def groups(names: DataFrame, name: str, freq: str) -> DataFrame:
    """canonical, variants, status: 'auto' groups of two or more spellings, and what is 'held'.

    `names` has distinct names and the records they stand in. Held are names that hold
    two or more known surnames after their first word (a surname is known if a name
    with it stands in two records), alone, and groups whose spellings have different
    middle initials, under their first spelling. The others' canonical spelling is one
    without a parenthesis, then the most frequent, then the one of most words, then the
    first. `variants` is a sorted list. A name of one word is in no group; a single
    spelling is none.
    """
    parsed = names.where(F.col(name).isNotNull()).select(F.col(name).alias("name"), F.col(freq).alias("freq"), normalised(F.col(name)).alias("norm")).withColumn("sig", signature(F.col("norm"))).where("sig IS NOT NULL")
    known = parsed.where("freq >= 2").select(F.col("sig.surname").alias("word")).distinct()
    words = parsed.select("name", F.explode(F.array_distinct(F.expr("slice(split(norm, ' '), 2, size(split(norm, ' ')))"))).alias("word"))
    double = words.join(known, "word").groupBy("name").agg(F.count("*").alias("hits")).where("hits >= 2").select("name")
    alone = double.select(F.col("name").alias("canonical"), F.array("name").alias("variants"), F.lit("held").alias("status"))
    rest = parsed.join(double, "name", "left_anti")
    grouped = rest.groupBy("sig.first", "sig.surname").agg(
        F.sort_array(F.collect_set("name")).alias("variants"),
        F.count_distinct(F.nullif("sig.middle", F.lit(""))).alias("middles"),
        F.max(F.struct((~F.contains("name", F.lit("("))).alias("clean"), "freq", F.size(F.split(F.trim("name"), r"\s+")).alias("words"))).alias("top"),
    )
    # Among equals the first spelling.
    ranked = rest.alias("r").join(grouped.alias("g"), F.expr("r.sig.first = g.first AND r.sig.surname = g.surname"))
    equal = (~F.contains("r.name", F.lit("(")) == F.col("g.top.clean")) & (F.col("r.freq") == F.col("g.top.freq")) & (F.size(F.split(F.trim("r.name"), r"\s+")) == F.col("g.top.words"))
    preferred = ranked.groupBy("g.first", "g.surname").agg(F.min(F.when(equal, F.col("r.name"))).alias("preferred"))
    both = grouped.where(F.size("variants") > 1).join(preferred, ["first", "surname"])
    held = F.col("middles") > 1
    return alone.unionByName(both.select(F.when(held, F.get("variants", F.lit(0))).otherwise(F.col("preferred")).alias("canonical"), "variants", F.when(held, "held").otherwise("auto").alias("status")))
