"""Text expressions shared by the operators, all of them built-in and JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of the collection: space, tab, newline and U+00A0.
SPACE = " \t\n "


def trimmed(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def folded(text: Column) -> Column:
    """Runs of white space as one space, ends trimmed, lower case; null stays null."""
    return F.lower(F.trim(F.regexp_replace(text, f"[{SPACE}]+", " ")))


def _designation(item: Column) -> Column:
    named = F.coalesce(F.try_variant_get(item, "$.designation", "variant"), F.try_variant_get(item, "$.name", "variant"))
    return F.when(F.schema_of_variant(named) == "STRING", named.cast("string"))


def terms(value: Column) -> Column:
    """The terms of a JSON text, as an array without nulls, in order.

    A string is one term; an array gives the terms of its elements; an object gives
    its `designation` if it has one, else its `name`; numbers, booleans, nulls and
    texts that are no JSON give none. A string is never parsed a second time. Arrays
    within arrays are opened at any depth: as many rounds as the text has brackets are
    enough, and that is one for most.
    """
    parsed = F.try_parse_json(value)
    opened = lambda x: F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.array(x))
    depth = F.length(value) - F.length(F.replace(value, F.lit("[")))
    deeper = F.when(depth > 1, F.sequence(F.lit(2), depth)).otherwise(F.array().cast("array<int>"))
    items = F.aggregate(deeper, opened(parsed), lambda held, _: F.flatten(F.transform(held, opened)))
    texts = F.transform(items, lambda x: F.when(F.schema_of_variant(x) == "STRING", x.cast("string")).otherwise(_designation(x)))
    return F.coalesce(F.filter(texts, lambda x: x.isNotNull()), F.array().cast("array<string>"))


def plain_value(value: Column) -> Column:
    """The string that a JSON text is, else the text itself."""
    parsed = F.try_parse_json(value)
    return F.when(F.schema_of_variant(parsed) == "STRING", F.try_variant_get(parsed, "$", "string")).otherwise(value)


def shortened(text: Column, size: int = 160) -> Column:
    """At most `size` characters, with an ellipsis if something was cut."""
    return F.when(F.length(text) > size, F.concat(F.left(text, F.lit(size)), F.lit("…"))).otherwise(text)


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash of the text's UTF-8 bytes, as a long."""
    hexed = F.hex(F.encode(text, "UTF-8"))
    byte = lambda i: F.conv(F.substring(hexed, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint")
    places = F.when(F.length(hexed) > 0, F.sequence(F.lit(0), F.expr("0") + (F.length(hexed) / 2).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    mixed = F.aggregate(places, F.lit(2166136261).cast("bigint"), lambda h, i: F.pmod(h.bitwiseXOR(byte(i)) * F.lit(16777619).cast("bigint"), F.lit(4294967296).cast("bigint")))
    return F.when(text.isNotNull(), mixed)


def loose_json(text: Column) -> Column:
    """A JSON text out of what a model wrote: code fences cut off, else the outermost braces, and one level of quoting undone; null if nothing parses."""
    bare = F.trim(F.regexp_replace(text, r"^\s*```[a-zA-Z]*\s*|\s*```\s*$", ""))
    inner = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    once = F.when(F.try_parse_json(bare).isNotNull(), bare).when(F.try_parse_json(inner).isNotNull(), inner)
    quoted = F.when(F.schema_of_variant(F.try_parse_json(once)) == "STRING", F.try_variant_get(F.try_parse_json(once), "$", "string"))
    return F.when(quoted.isNotNull() & F.try_parse_json(quoted).isNotNull(), quoted).otherwise(once)


# Words that tell nothing of what a text is about.
STOPWORDS = tuple(
    """the a an of to in on for and or is are was were be as by with from at this that it its
    which who whom whose what how many much does do did will would should could may might
    study thesis report author standard approach used uses using based their they them
    provides provide recommends recommend federal""".split()
)


def words(body: Column) -> Column:
    """The different words of ASCII letters and digits, in lower case, without STOPWORDS; none of null."""
    found = F.regexp_extract_all(F.lower(F.coalesce(body, F.lit(""))), F.lit("([a-z0-9]+)"))
    return F.array_distinct(F.filter(found, lambda x: ~x.isin(*STOPWORDS)))


def significant(body: Column) -> Column:
    """Those of `words` that have at least four characters or are numbers."""
    return F.filter(words(body), lambda x: (F.length(x) >= 4) | x.rlike("^[0-9]+$"))


def clamped(value: Column) -> Column:
    """A number held within 0 and 1, as a double; 0.5 for what is none."""
    number = value.try_cast("double")
    return F.when(number.isNull(), 0.5).otherwise(F.greatest(F.least(number, F.lit(1.0)), F.lit(0.0)))


def token_count(counts: Column, key: str) -> Column:
    """A number out of a JSON object, 0 where it is missing, null or no number."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(counts), f"$.{key}", "bigint"), F.lit(0).cast("bigint"))


def follow_ups(reply: Column, sentinel: str, most: int = 3) -> Column:
    """The questions after a sentinel line, bullets and numbers taken off, at most `most`; none without the sentinel."""
    after = F.when(F.contains(reply, F.lit(sentinel)), F.substring_index(reply, sentinel, -1)).otherwise(F.lit(""))
    lines = F.transform(F.split(after, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:[-*•]|\d+[.)])\s*", "")))
    return F.slice(F.filter(lines, lambda x: x != ""), 1, most)


def loose_array(text: Column) -> Column:
    """The elements, as JSON texts, of an array that a model wrote: bare, fenced, quoted, or the only array within an object; null if there is none."""
    parsed = F.try_parse_json(loose_json(text))
    inside = F.try_variant_get(parsed, "$", "map<string, variant>")
    arrays = F.filter(F.transform(F.map_values(inside), lambda v: F.try_variant_get(v, "$", "array<variant>")), lambda a: a.isNotNull())
    found = F.coalesce(F.try_variant_get(parsed, "$", "array<variant>"), F.when(F.size(arrays) == 1, F.get(arrays, F.lit(0))))
    return F.transform(found, lambda v: F.to_json(v))
