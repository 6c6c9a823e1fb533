"""Spellings of names that stand for one person or organisation.

Each name is rewritten to its canonical key (short forms to full names, legal forms
and words written out, parts in one order), and each key to every writing that its
bearer may use and to every form it shares with misread ones. The forms are exploded
and meet by equality, and a form counts by how rare it is: one that several bearers
could have written links nothing, and a misreading is one only where its words are
rare beside those it was read from.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgraph.llm.name_rules import cut_down, key_of, misread_forms
from claimgraph.sources import stage

_SEP = "\x1f"
#: A word is misread from one that at least WORN times as many keys bear; or, borne by no other key or from one OFTEN times as much borne, from one whose key is written in several ways and OFTEN times as often.
WORN, OFTEN = 4, 2
#: Bearers of a word are joined in so many parts, so that a given name that a third of all keys bear is several tasks' work.
SALTS = 16


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [key_of(n) for n in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.string())], names=["name", "n", "key", "generation"])


def _listed(of: Callable[[str], list[str]]):
    """Adds the list of forms that `of` gives for the first column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = pa.array([of(k) for k in batch.column(0).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, forms], names=[*batch.schema.names, "forms"])

    return run


def _with_forms(rows: DataFrame, of: Callable[[str], list[str]]) -> DataFrame:
    return rows.mapInArrow(_listed(of), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", forms array<string>")


def _borne(keys: DataFrame) -> DataFrame:
    """`keys` with `words`: the surname and given name, or the words of the place and body, of each key with the number of keys that bear each word; none bears a word with a digit in it."""
    part = F.split("key", _SEP)
    kind, first, second = (F.get(part, F.lit(i)) for i in range(3))
    worded = F.array_distinct(F.concat(F.array(first), F.when(kind == "b", F.split(second, " ")).otherwise(F.array(second))))
    spread = keys.select("key", kind.alias("kind"), F.explode(worded).alias("word"), F.pmod(F.xxhash64("key"), F.lit(SALTS)).alias("salt"))
    bearers = spread.groupBy("kind", "word").agg(F.when(F.col("word").rlike("[0-9]"), 0).otherwise(F.count("*")).alias("bearers")).select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt"))
    counted = spread.join(bearers, ["kind", "word", "salt"]).groupBy("key").agg(F.collect_set(F.struct("word", "bearers")).alias("words"))
    return keys.join(counted, "key")


def _misreads() -> Column:
    """Whether the key of a row is a misreading of `best`: written in one way only, or in fewer than the other, with words that are rare beside the other's, and not much more often; or seldom, beside one that is written in several ways."""
    theirs = F.expr("filter(best.words, x -> NOT exists(words, y -> y.word = x.word))")
    ours = F.expr("filter(words, x -> NOT exists(best.words, y -> y.word = x.word))")
    most = F.coalesce(F.array_max(F.transform(ours, lambda x: x.bearers)), F.lit(0))
    least = F.coalesce(F.array_min(F.transform(theirs, lambda x: x.bearers)), F.lit(0))
    worn = (least >= WORN * most) & (F.col("n") * most <= F.col("best.n") * least)
    varied = ((most <= 1) | (least >= OFTEN * most)) & (F.col("best.ways") > 1) & (F.col("best.n") >= OFTEN * F.col("n"))
    return (F.col("key") != F.col("best.key")) & ((F.col("ways") == 1) | (F.col("ways") < F.col("best.ways"))) & (worn | varied)


def _followed(moved: DataFrame) -> DataFrame:
    """key, head: links to heads followed to their end; each round doubles the links that are followed. Heads rank higher, so they end."""
    now = stage(moved.withColumn("further", F.lit(True)), "further")
    while now.held:
        step = now.df.alias("x").join(now.df.alias("y"), F.expr("x.head = y.key"), "left")
        following = stage(step.select("x.key", F.coalesce("y.head", "x.head").alias("head"), F.col("y.head").isNotNull().alias("further")), "further")
        now.drop()
        now = following
    return now.df.drop("further")


def _heads(keys: DataFrame) -> DataFrame:
    """key, head: the key that a misread key was read from, followed on; a key without one, or with several that end apart, has no row.

    `keys` has key, n (its occurrences), ways (its spellings), words and forms. Of the
    keys that share a form, the one whose words most keys bear may be the head, and
    only if all others are misreadings of it.
    """
    rank = [F.array_min(F.transform("words", lambda w: w.bearers)).alias("borne"), F.col("n"), F.col("key")]
    shared = keys.select("key", "n", "ways", "words", F.struct(*rank).alias("rank"), F.explode("forms").alias("form")).repartition("form")
    best = shared.groupBy("form").agg(F.max(F.struct("rank", "key", "n", "ways", "words")).alias("best"), F.count("*").alias("sharers")).where("sharers > 1")
    judged = shared.join(best.select("form", "best"), "form").select("form", "key", "rank", "best.rank", _misreads().alias("misread")).toDF("form", "key", "own", "rank", "misread")
    firm = judged.groupBy("form").agg(F.count_if(~F.col("misread")).alias("firm")).where("firm = 1").select("form")
    links = stage(judged.where("misread").join(firm, "form", "left_semi").select("key", F.col("rank").alias("head")).distinct())
    one = links.df.groupBy("key").agg(F.max("head")["key"].alias("head"))
    ends = _followed(one)
    through = links.df.select("key", F.col("head.key").alias("via")).alias("l").join(ends.alias("e"), F.expr("l.via = e.key"), "left")
    apart = stage(through.select("l.key", F.coalesce("e.head", "l.via").alias("end")).groupBy("key").agg(F.min("end").alias("a"), F.max("end").alias("b")).where("a <> b").select("key"))
    if apart.rows:
        ends = _followed(one.join(apart.df, "key", "left_anti"))
    return ends


def _writings(own: str) -> list[str]:
    """Every other key and generation that the bearer of `own` may be written by."""
    key, generation = own.rsplit(_SEP, 1)
    return sorted({f"{k}{_SEP}{g}" for k in (key, *cut_down(key)) for g in (generation, "")} - {own})


def link(names: DataFrame, name: str, weight: str) -> DataFrame:
    """name, entity: each distinct name and the entity it stands for, or null if it stands for none or may stand for several.

    `names` has one row for each distinct name with the number of times it occurs.
    Null names are left out. Names are parsed once, forms made once for each distinct
    key; then only equi-joins and combining aggregates run. Forms follow from keys, so
    the result does not depend on the layout of the rows.
    """
    rows = names.where(F.col(name).isNotNull()).select(F.col(name).alias("name"), F.col(weight).cast("long").alias("n"))
    parsed = stage(rows.repartition("name").mapInArrow(_rewrite, "name string, n bigint, key string, generation string"))
    keyed = parsed.df.where("key IS NOT NULL")
    keys = _borne(keyed.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("ways")))
    heads = _heads(stage(_with_forms(keys, misread_forms)).df)
    now = keyed.alias("k").join(heads.alias("h"), F.expr("k.key = h.key"), "left").select("k.name", F.concat_ws(_SEP, F.coalesce("h.head", "k.key"), "k.generation").alias("own"))
    own = stage(now).df
    written = stage(_with_forms(own.select("own").distinct(), _writings)).df
    others = written.select(F.explode("forms").alias("own")).distinct()
    entities = written.join(others, "own", "left_anti")
    forms = entities.select(F.explode(F.array_append("forms", F.col("own"))).alias("form"), F.col("own").alias("entity"))
    rare = forms.groupBy("form").agg(F.count("*").alias("bearers"), F.min("entity").alias("entity")).where("bearers = 1")
    found = own.alias("o").join(rare.alias("r"), F.expr("o.own = r.form"), "left").select("o.name", "r.entity")
    rest = parsed.df.where("key IS NULL").select("name", F.lit(None).cast("string").alias("entity"))
    return found.unionByName(rest)


def pairs(linked: DataFrame) -> DataFrame:
    """name_a, name_b: each two different names of one entity, the smaller (by bytes) first."""
    held = linked.where("entity IS NOT NULL")
    return held.alias("x").join(held.alias("y"), F.expr("x.entity = y.entity AND x.name < y.name")).select(F.col("x.name").alias("name_a"), F.col("y.name").alias("name_b"))
