"""The graph that claims draw between records, contexts and the entities they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimgraph.functions.text import terms
from claimgraph.operators.catalog import IDENTIFIER_KEY, LONGEST
from claimgraph.operators.claims import live, understanding
from claimgraph.sources import stage

# A key's category is the first whose words it contains.
CATEGORIES = (
    ("citation", r"cited|citation|bibliograph|reference|source|supersed|related_(report|work)|works?$"),
    ("authority", IDENTIFIER_KEY + r"|authority|authorized|control|lccn|call_number|classification"),
    ("agent", r"advisor|author|agency|agencies|department|office|committee|sponsor|witness|person|actor|organization|institution"),
    ("subject", r"subject|keyword|index_terms|topic|theme|cluster|tag|issue|domain"),
    ("evidence", r"evidence|finding|method|basis|quote|passage|excerpt|indicator|risk|rationale"),
)


def category(key: Column) -> Column:
    out = F.when(key == "in-context", "context")
    for name, words in CATEGORIES:
        out = out.when(key.rlike(words), name)
    return out.otherwise("other")


def node_id(kind: Column, ident: Column) -> Column:
    return F.concat(kind, F.lit("/"), ident)


def named(claims: DataFrame) -> DataFrame:
    """node, key, term, plain (the value is that one string), confidence, seen_at: the short terms of live understanding claims."""
    held = claims.where(live() & understanding())
    node = node_id(F.col("tendable_type"), F.col("tendable_id")).alias("node")
    plain = (F.schema_of_variant(F.try_parse_json("value")) == "STRING").alias("plain")
    spread = held.select(node, "key", plain, F.explode(terms(F.col("value"))).alias("t"), "confidence", F.col("created_at").alias("seen_at"))
    short = F.length("term").between(1, LONGEST)
    return spread.withColumn("term", F.trim(F.regexp_replace("t", "^[\\s ]+|[\\s ]+$", ""))).where(short).drop("t")


def entity_index(claims: DataFrame) -> DataFrame:
    """term, node: identifying strings and titles, in lower case, that only one record has; a term of several resolves to nothing, nor does one out of an array or object."""
    held = named(claims).where(F.col("plain") & (F.col("key").rlike(IDENTIFIER_KEY) | (F.col("key") == "title"))).withColumn("term", F.lower("term"))
    return held.groupBy("term").agg(F.min("node").alias("node"), F.max("node").alias("other")).where("node = other").drop("other")


def edges(claims: DataFrame, memberships: DataFrame) -> DataFrame:
    """s, t, key, category, weight, seen_at: record to context by membership, record to record or entity by claim.

    A term that identifies a record leads to it, any other to the entity 'term/...';
    terms are one without regard to case.
    Parallel edges of a key are one, with the greatest confidence and the first date;
    a record has no edge to itself.
    """
    index = entity_index(claims).select(F.col("term").alias("__term"), F.col("node").alias("__node"))
    drawn = named(claims).where(~F.col("key").rlike(IDENTIFIER_KEY) & (F.col("key") != "title")).withColumn("term", F.lower("term")).join(index, F.col("term") == F.col("__term"), "left")
    target = F.coalesce("__node", F.concat(F.lit("term/"), "term"))
    spoken = drawn.select(F.col("node").alias("s"), target.alias("t"), "key", F.col("confidence").alias("weight"), "seen_at").where("s <> t")
    placed = memberships.select(node_id(F.col("member_type"), F.col("member_id")).alias("s"), F.concat(F.lit("context/"), F.col("context_id").cast("string")).alias("t"), F.lit("in-context").alias("key"), F.lit(1.0).alias("weight"), F.col("created_at").alias("seen_at"))
    merged = spoken.unionByName(placed).groupBy("s", "t", "key").agg(F.max("weight").alias("weight"), F.min("seen_at").alias("seen_at"))
    return merged.withColumn("category", category(F.col("key")))


def degrees(drawn: DataFrame) -> DataFrame:
    """node, degree, categories: the edges at each node and the different categories among them."""
    ends = drawn.select(F.explode(F.array("s", "t")).alias("node"), "category")
    return ends.groupBy("node").agg(F.count("*").alias("degree"), F.count_distinct("category").alias("categories"))


def nodes(drawn: DataFrame) -> DataFrame:
    """node, kind, degree, priority: labels matter most for contexts, then well-linked records, then shared entities."""
    kind = F.when(F.col("node").startswith("context/"), "context").when(F.col("node").startswith("term/"), "entity").otherwise("record")
    counted = degrees(drawn).withColumn("kind", kind)
    priority = F.when(F.col("kind") == "context", 100).when((F.col("kind") == "record") & (F.col("degree") >= 10), 80).when((F.col("kind") == "entity") & (F.col("degree") >= 10), 60).otherwise(0)
    return counted.select("node", "kind", "degree", priority.cast("bigint").alias("priority"))


def strength() -> Column:
    """An edge's weight; one without counts as 0.5."""
    return F.coalesce(F.when(F.col("weight") != 0, F.col("weight")), F.lit(0.5))


def grouped(claims: DataFrame, closed: DataFrame) -> DataFrame:
    """node, group: each record's deepest context among its live understanding claims, the smaller id among equals; none for a record read at the root only."""
    depths = closed.groupBy("context_id").agg(F.max("depth").alias("depth"))
    held = claims.where(live() & understanding() & F.col("context_id").isNotNull()).select(node_id(F.col("tendable_type"), F.col("tendable_id")).alias("node"), "context_id")
    best = F.max(F.struct(F.coalesce("depth", F.lit(0)).alias("depth"), (-F.col("context_id")).alias("least")))
    return held.join(depths, "context_id", "left").groupBy("node").agg((-best["least"]).alias("group"))


def overview_nodes(drawn: DataFrame, groups: DataFrame, most: int = 240) -> DataFrame:
    """node: what the overview shows, at most `most`: contexts, the best-linked records of each group, the ends of the 80 strongest links between records, the 70 best-linked entities of at least two links, then records until there are `most`.

    Nodes are taken in that order, contexts by name, groups by context id with the
    root last, equal degrees by name, so the cut is the same each time.
    """
    kind = F.when(F.col("node").startswith("context/"), "context").when(F.col("node").startswith("term/"), "entity").otherwise("record")
    known = stage(degrees(drawn).select("node", "degree", kind.alias("kind"))).df
    records = known.where("kind = 'record'").join(groups, "node", "left")
    n_groups = records.agg(F.count_distinct(F.coalesce("group", F.lit(-1))).alias("n")).first()["n"]
    each = min(max(-(-130 // max(n_groups, 1)), 18), 55)
    linked = [F.col("degree").desc(), F.col("node")]
    place = lambda part, b=F.lit(0), a=F.lit(0): F.struct(F.lit(part).alias("part"), a.cast("bigint").alias("a"), b.cast("bigint").alias("b"), "node").alias("place")
    ranked = records.withColumn("r", F.row_number().over(Window.partitionBy("group").orderBy(*linked))).where(F.col("r") <= each)
    ends = known.where("kind = 'record'").select("node")
    between = drawn.where("category <> 'context'").join(ends.withColumnRenamed("node", "s"), "s", "left_semi").join(ends.withColumnRenamed("node", "t"), "t", "left_semi")
    strongest = between.orderBy(strength().desc(), "key", "s", "t").limit(80)
    order = F.row_number().over(Window.orderBy(F.col("w").desc(), "key", "s", "t"))  # of 80 rows
    strong = strongest.withColumn("w", strength()).withColumn("r", order).select("r", F.posexplode(F.array("s", "t")).alias("end", "node"))
    parts = [
        known.where("kind = 'context'").select("node", place(1)),
        ranked.select("node", place(2, F.col("r"), F.coalesce("group", F.lit((1 << 63) - 1)))),
        strong.select("node", place(3, 2 * F.col("r") + F.col("end"))),
        known.where("kind = 'entity' AND degree >= 2").orderBy(*linked).limit(70).select("node", place(4, -F.col("degree"))),
        known.where("kind = 'record'").orderBy(*linked).limit(most).select("node", place(5, -F.col("degree"))),
    ]
    chosen = parts[0]
    for p in parts[1:]:
        chosen = chosen.unionByName(p)
    return chosen.groupBy("node").agg(F.min("place").alias("place")).orderBy("place").limit(most).select("node")


def overview(drawn: DataFrame, kept: DataFrame, most: int = 420) -> DataFrame:
    """The `most` edges shown among the nodes `kept`, of which there are few: links to contexts last, stronger first."""
    shown = drawn.join(F.broadcast(kept.select(F.col("node").alias("s"))), "s", "left_semi").join(F.broadcast(kept.select(F.col("node").alias("t"))), "t", "left_semi")  # as many as overview_nodes gives
    return shown.orderBy(F.col("category") == "context", strength().desc(), "key", "s", "t").limit(most)


def filtered(drawn: DataFrame, least: float | None = None, categories: list[str] | None = None, since: object = None, until: object = None) -> DataFrame:
    """The edges of at least some weight (null counts as 0), of some categories, seen within a time; bounds included, None for no bound."""
    out = drawn
    if least:
        out = out.where(F.coalesce("weight", F.lit(0.0)) >= least)
    if categories:
        out = out.where(F.col("category").isin(*categories))
    if since is not None:
        out = out.where(F.col("seen_at") >= F.lit(since).cast("timestamp_ntz"))
    return out if until is None else out.where(F.col("seen_at") <= F.lit(until).cast("timestamp_ntz"))


def uncrowded(drawn: DataFrame, most: int) -> DataFrame:
    """term, mentions: the unresolved entities that are drawn: all, if there are no more than `most`, else the `most` commonest of those with two or more edges."""
    counts = drawn.where(F.col("t").startswith("term/")).groupBy(F.col("t").alias("term")).agg(F.count("*").alias("mentions"))
    known = stage(counts, "mentions >= 2")
    if known.rows <= most:
        return known.df
    return known.df.where("mentions >= 2").orderBy(F.col("mentions").desc(), "term").limit(most)


def found(shown: DataFrame, text: str) -> DataFrame:
    """The node of `nodes` that a search means: that of this name, else the one that contains it, of the greatest priority, then degree, then first by name; letters' case does not count."""
    name = F.lower(F.expr("substring(node, instr(node, '/') + 1)"))
    hits = shown.where(F.contains(name, F.lit(text.lower()))).withColumn("exact", (name == text.lower()).cast("int"))
    return hits.orderBy(F.col("exact").desc(), F.col("priority").desc(), F.col("degree").desc(), "node").limit(1).drop("exact")


def connections(drawn: DataFrame, node: str, most: int = 40) -> DataFrame:
    """direction, other, key, weight: a node's edges out and in, at most `most` of each, heaviest first."""
    sides = [drawn.where(F.col("s") == node).select(F.lit("out").alias("direction"), F.col("t").alias("other"), "key", "weight"), drawn.where(F.col("t") == node).select(F.lit("in").alias("direction"), F.col("s").alias("other"), "key", "weight")]
    some = [x.orderBy(F.col("weight").desc_nulls_last(), "other", "key").limit(most) for x in sides]
    return some[0].unionByName(some[1])


def capped(drawn: DataFrame, most: int) -> DataFrame:
    """The edges among the `most` best-linked nodes; equal degrees in order of the name. The edges are written once."""
    drawn = stage(drawn).df
    kept = degrees(drawn).orderBy(F.col("degree").desc(), "node").limit(most).select("node")
    left = drawn.join(F.broadcast(kept.select(F.col("node").alias("s"))), "s", "left_semi")  # at most `most` rows
    return left.join(F.broadcast(kept.select(F.col("node").alias("t"))), "t", "left_semi")


def focus(drawn: DataFrame, centre: str, hops: int = 2, most: int = 250) -> DataFrame:
    """node, hop: what lies within `hops` links of a node, nearest and best-linked first, at most `most`.

    One semi-join a hop over the edges, which are written once; context links are
    followed to contexts but not out of them.
    """
    drawn = stage(drawn.select("s", "t", "category")).df
    both = drawn.select("s", "t").unionByName(drawn.select(F.col("t").alias("s"), F.col("s").alias("t"))).where(~F.col("s").startswith("context/")).distinct()
    reached = drawn.sparkSession.createDataFrame([(centre, 0)], "node string, hop int")
    front = reached
    for hop in range(1, hops + 1):
        step = both.join(front.select(F.col("node").alias("s")), "s", "left_semi").select(F.col("t").alias("node")).distinct()
        front = step.join(reached.select("node"), "node", "left_anti").select("node", F.lit(hop).alias("hop"))
        reached = reached.unionByName(front)
    near = drawn.select(F.explode(F.array("s", "t")).alias("node")).join(reached.select("node"), "node", "left_semi").groupBy("node").agg(F.count("*").alias("degree"))
    ranked = reached.join(near, "node", "left").orderBy("hop", F.coalesce("degree", F.lit(0)).desc(), "node").limit(most)
    return ranked.select("node", "hop")


def neighbours(drawn: DataFrame, centre: str, most: int, by: str = "relation") -> DataFrame:
    """node, links, degree: who is linked to a node; most links first (`by` 'relation'), best-linked ('degree') or last linked to ('recency')."""
    near = drawn.where(F.col("s") == centre).select(F.col("t").alias("node"), "seen_at").unionByName(drawn.where(F.col("t") == centre).select(F.col("s").alias("node"), "seen_at"))
    counted = near.groupBy("node").agg(F.count("*").alias("links"), F.max("seen_at").alias("last_at"))
    # Degrees are counted of the neighbours alone.
    ends = drawn.select(F.explode(F.array("s", "t")).alias("node")).join(counted.select("node"), "node", "left_semi").groupBy("node").agg(F.count("*").alias("degree"))
    order = {"relation": [F.col("links").desc(), F.col("degree").desc()], "degree": [F.col("degree").desc()], "recency": [F.col("last_at").desc_nulls_last()]}[by]
    return counted.join(ends, "node").orderBy(*order, "node").limit(most).select("node", "links", "degree")


def edge_types(drawn: DataFrame, most: int = 6) -> DataFrame:
    """kind, key, n, place: the commonest keys of the edges that leave each kind of record."""
    counted = drawn.groupBy(F.substring_index("s", "/", 1).alias("kind"), "key").agg(F.count("*").alias("n"))
    return counted.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy(F.col("n").desc(), "key"))).where(F.col("place") <= most)


def time_range(drawn: DataFrame) -> DataFrame:
    """first_at, last_at of the edges."""
    return drawn.agg(F.min("seen_at").alias("first_at"), F.max("seen_at").alias("last_at"))


def entity_keys(claims: DataFrame, longest: int = LONGEST) -> DataFrame:
    """key, n_terms, median_length: the keys whose terms are short in the (upper) median.

    Lengths are few, so the median comes from their counts by key.
    """
    lengths = named(claims).groupBy("key", F.length("term").alias("size")).agg(F.count("*").alias("n"))
    running = lengths.withColumns({"upto": F.sum("n").over(Window.partitionBy("key").orderBy("size")), "n_terms": F.sum("n").over(Window.partitionBy("key"))})
    medians = running.where("upto > n_terms div 2").groupBy("key").agg(F.max("n_terms").alias("n_terms"), F.min("size").alias("median_length"))
    return medians.where(F.col("median_length") <= longest)
