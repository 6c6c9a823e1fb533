"""Statistics of texts, and whether a text is running prose or a list, a table or junk.

A text is read in units: lines, with hard-wrapped ones joined. Incremental
reduced-error pruning learns two rule lists on labelled documents: one tells units of
prose from others, one tells lists, tables and junk by the features of a whole text.
As CASE expressions they are applied to every unit and every document; a document is
prose if at least half of its characters stand in prose. All features are built-in
expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgraph.llm.rules import RuleList, induce
from claimgraph.sources import stage

# Common words of the collection's languages that are written with spaces; those of CLAUSE need a clause around them, the others also stand in titles and list items.
CLAUSE = """
and is was were be been are has have had not but which who it they he she we you this these would could will may can did does their his her no only if when than then there because although
et est sont ont été avait mais qui que pas ne nous il elle ils elles leur ce cette si car on
y es fue había no pero que se lo su sus si como ya han era
e é foi são mas não que se seu sua já nos ele ela
und nicht ist war sind wurde wurden haben hat aber dass sich auch wenn als es er sie wir
и не что это как но он она они был были было же его к по
""".split()
PHRASE = """
the of to in that those with for from by at on as or do our into about after before
de la le les des en un une dans pour plus par sur au aux
el los las del con por para más una al
o os as do da dos das em um uma ao mais por
der die das den dem des ein eine einen zu von mit für auf noch nach vor
в на с из у после этого от для
""".split()
# The same of Chinese and Japanese, matched within runs of Han and kana.
RUN_CLAUSE = """
是 了 没 不 也 就 都 但 们 他 她 它 我 你 这 那 谁 很 已 会 能 着 过 被 把 因为 如果 所以
は が を た だ です ます した ない から ので なぜ しかし また いる ある
""".split()
RUN_PHRASE = """
的 在 和 与 及 之 于 从 对 为 以
の に と で も へ や まで より など
""".split()
#: A word: a run of letters and what is written with them; an apostrophe inside belongs to it.
WORD = r"(\p{L})[\p{L}\p{M}'’]*"
#: Runs of Han and kana have no spaces: each of their letters is a word, a common one if it stands in one of the words above.
RUN = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー"
RUN_LETTER, RUN_BREAK = rf"[{RUN}&&\p{{L}}]+", rf"[{RUN}]+"
#: White space but for the plain one and the tab.
ODD_SPACE = "[  -​ 　﻿\u000b\r]"
HAN = r"぀-ヿ㐀-䶿一-鿿"
#: A line break inside a sentence: after a letter or comma, before a small letter.
WRAP = r"\n(?=\p{Ll})(?<=[\p{L},][ \t]{0,8}\n)"
#: The same after more blanks than WRAP looks back over; looked for only in texts that have a tab or as many blanks.
BLANKS, WRAP_FAR = " " * 9, r"([\p{L},][ \t]{9,})\n(?=\p{Ll})"
WRAPPED = "⁣"
# The following are looked for in a unit's skeleton, in which each word is its first letter.
END = rf"[.!?。！？…](?<=[\p{{L}}\p{{N}})\]\"”»’%].)(?=[.!?。！？…]*[\"”»)’」]*(?:\s|$|[{HAN}]))"
SEPARATOR = r"[|;·•\t=/]| (?= )(?<![ ].)"
# The following are looked for in the unit itself, at its ends.
MARK = r"\A[ \t]*((?:[-*•·–—◦▪+>]|\(?\p{N}{1,3}[.):]|\(?[a-z][.)]|\p{N}+(?:\.\p{N}+)+)[ \t])?"
FULL = r"[.!?。！？…][\"”»)’」]*\s*$"
#: An end of a unit that leaves open what stands before it.
TAIL = r"\A[\"”»)’」\s\u0085  ]{12}\z"
#: The comparisons that each feature may be used in: what speaks for prose, first of all.
SIDES = {"ends": ">", "common": ">", "clause": ">", "letters": ">", "full_stop": ">", "chars": ">", "seps": "<=", "marked": "<=", "symbols": "<=", "digits": "<=", "odd": "<=", "word_length": "<="}
FEATURES = ["letters", "digits", "symbols", "word_length", "upper", "common", "clause", "ends", "span", "seps", "marked", "odd", "runs", "full_stop", "chars"]
PROSE, KINDS = "prose", ("table", "junk", "list")
#: What is added up over the units of a text, and its features made of that.
SUMS = ["chars", "words", "n_letters", "n_digits", "n_common", "n_upper", "n_ends", "n_seps", "n_odd", "lines", "marked", "full_stop"]
TEXT_FEATURES = ["letters", "digits", "symbols", "word_length", "upper", "common", "ends", "seps", "odd", "marked_lines", "ended_lines", "line_chars", "line_words"]
#: At most so many labelled documents, and so many units of them, are used to learn the rules.
LABELLED_DOCUMENTS, LABELLED_UNITS = 6_000, 150_000


def _without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def _one_of(words: list[str]) -> str:
    return "|".join(sorted(dict.fromkeys(words), key=lambda w: (-len(w), w)))


def units(rows: DataFrame, key: str, text: str, *keep: str) -> DataFrame:
    """key, place, keep..., lines (that were joined; 0 for a blank unit), and the features of each unit, blank ones with no characters. A null text is one blank unit.

    Every unit is read by few patterns: most counts come from its skeleton, which is
    as many times shorter as words are long.
    """
    body = F.col(text).cast("string")
    # Each unit counts its own lines: a wrapped one has its break as a mark instead.
    plain = F.replace(F.replace(body, F.lit("\r\n"), F.lit("\n")), F.lit("\f"), F.lit("\n"))
    near = F.when(F.contains(plain, F.lit(BLANKS)) | F.contains(plain, F.lit("\t")), F.regexp_replace(plain, WRAP_FAR, f"$1 {WRAPPED}")).otherwise(plain)
    joined = F.split(F.regexp_replace(near, WRAP, f" {WRAPPED}"), "\n")
    cut = rows.select(F.col(key).alias("key"), *keep, F.posexplode_outer(joined).alias("place", "u"))
    u = F.coalesce("u", F.lit(""))
    broken = 1 + F.length(u) - F.length(F.replace(u, F.lit(WRAPPED)))
    bare = F.replace(u, F.lit(WRAPPED))
    spaced = F.when((F.octet_length(bare) > F.length(bare)) | F.contains(bare, F.lit("\r")), F.regexp_replace(bare, ODD_SPACE, " ")).otherwise(bare)
    shaped = cut.select("key", "place", *keep, broken.alias("broken"), spaced.alias("u"))
    u = F.col("u")
    size, end = F.length("u"), F.right(u, F.lit(12))
    # Most units are spared the look for runs by their bytes, the others by their letters.
    runs = (F.octet_length("u") > size) & u.rlike(f"[{RUN}]")
    shaped = shaped.withColumns({"runs": runs, "skeleton": F.regexp_replace("u", WORD, "$1")})
    in_runs = lambda pattern: F.when(F.col("runs"), size - _without(u, pattern)).otherwise(0)
    # What is left of the skeleton without letters, and without spaces, is short.
    shaped = shaped.withColumn("unlettered", F.regexp_replace("skeleton", r"[\p{L}\p{M}]+", ""))
    rest = F.replace(F.replace("unlettered", F.lit(" ")), F.lit("\t"))
    counted = shaped.withColumn("rest", rest).select(
        "key",
        "place",
        *keep,
        "broken",
        (size - F.length("unlettered")).alias("n_letters"),
        F.length("rest").alias("n_rest"),
        F.regexp_extract_all(F.when(F.col("runs"), F.regexp_replace("u", RUN_BREAK, " ")).otherwise(u), F.lit(WORD), F.lit(0)).alias("w"),
        in_runs(RUN_LETTER).alias("n_run"),
        in_runs(_one_of(RUN_CLAUSE + RUN_PHRASE)).alias("n_run_common"),
        in_runs(_one_of(RUN_CLAUSE)).alias("n_run_clause"),
        (F.length("rest") - _without(F.col("rest"), r"\p{N}+")).alias("n_digits"),
        F.length(F.regexp_replace("skeleton", r"[^\p{Lu}]+", "")).alias("n_upper"),
        (F.length("skeleton") - _without(F.col("skeleton"), END)).alias("n_ends"),
        (F.length("skeleton") - _without(F.col("skeleton"), SEPARATOR)).alias("n_seps"),
        F.when(F.octet_length("rest") > F.length("rest"), F.length("rest") - _without(F.col("rest"), r"[\u0080-¿�]+")).otherwise(0).alias("n_odd"),
        (F.regexp_extract(u, MARK, 1) != "").cast("double").alias("marked"),
        F.when(end.rlike(TAIL), u.rlike(FULL)).otherwise(end.rlike(FULL)).cast("double").alias("full_stop"),
    )
    everyday, clause = ([x for w in dict.fromkeys(words) for x in dict.fromkeys((w, w.capitalize(), w.upper()))] for words in (CLAUSE + PHRASE, CLAUSE))
    known = counted.withColumn("c", F.filter("w", lambda w: w.isin(everyday)))
    sizes = {
        "chars": F.col("n_letters") + F.col("n_rest"),
        "words": F.size("w") + F.col("n_run"),
        "n_common": F.size("c") + F.col("n_run_common"),
        "n_clause": F.size(F.filter("c", lambda w: w.isin(clause))) + F.col("n_run_clause"),
    }
    return _shares(known.withColumns(sizes).withColumn("lines", F.when(F.col("chars") > 0, F.col("broken")).otherwise(0))).withColumns(
        {
            "clause": F.col("n_clause") / F.greatest("words", F.lit(1)),
            "span": F.when(F.col("n_ends") > 0, F.col("chars") / F.col("n_ends")).otherwise(999.0),
            "runs": F.col("n_run") / F.greatest("chars", F.lit(1)),
        }
    ).drop("w", "c", "broken", "n_rest", "n_run", "n_run_common", "n_run_clause")


def _shares(rows: DataFrame) -> DataFrame:
    """The features that units and texts have in common, from their counts."""
    share = lambda c, of="chars": F.col(c) / F.greatest(F.col(of), F.lit(1))
    return rows.withColumns(
        {
            "letters": share("n_letters"),
            "digits": share("n_digits"),
            "symbols": (F.col("chars") - F.col("n_letters") - F.col("n_digits")) / F.greatest("chars", F.lit(1)),
            "word_length": share("n_letters", "words"),
            "upper": share("n_upper", "words"),
            "common": share("n_common", "words"),
            "ends": share("n_ends") * 100,
            "seps": share("n_seps") * 100,
            "odd": share("n_odd"),
        }
    )


def _texts(judged: DataFrame, *more: Column) -> DataFrame:
    """key, SUMS, TEXT_FEATURES and `more` sums of each text."""
    summed = judged.groupBy("key").agg(*(F.sum(c).cast("long").alias(c) for c in SUMS), *more)
    line = lambda c: F.col(c) / F.greatest("lines", F.lit(1))
    return _shares(summed).withColumns({"marked_lines": line("marked"), "ended_lines": line("full_stop"), "line_chars": line("chars"), "line_words": line("words")})


@dataclass(frozen=True)
class Forms:
    """What is learnt: rules for units (prose or 'other') and for texts that are not prose."""

    units: RuleList = RuleList((), PROSE, (PROSE,))
    texts: RuleList = RuleList((), KINDS[-1], KINDS)


def learn(documents: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> Forms:
    """Rules for units and texts, from documents labelled with PROSE or one of KINDS.

    At most LABELLED_DOCUMENTS labels, chosen by a hash of the key, are taken to the
    driver and sent to the documents, whose texts are read once; at most
    LABELLED_UNITS units come back, and the features of each text. Both are chosen and
    ordered by a hash of key and place, so that the rules do not depend on how the
    rows are laid out. Other labels (such as blank) and null ones are left out.
    Without labels everything is prose.
    """
    held = labels.where(F.col(label).isin(PROSE, *KINDS) & F.col(key).isNotNull()).groupBy(key).agg(F.min(label).alias("__label"))
    chosen = held.orderBy(F.xxhash64(key), key).limit(LABELLED_DOCUMENTS).toPandas()
    if not len(chosen):
        return Forms()
    sample = documents.sparkSession.createDataFrame(chosen, held.schema)
    known = documents.select(key, text).join(F.broadcast(sample), key)  # at most LABELLED_DOCUMENTS rows
    read = stage(units(known, key, text, "__label").where("chars > 0"))
    drawn = read.df.select(F.xxhash64("key", "place").alias("__draw"), "key", "place", "__label", *FEATURES)
    seen = drawn.orderBy("__draw", "key", "place").limit(LABELLED_UNITS).toPandas()
    columns = {f: seen[f].to_numpy(float) for f in FEATURES}
    found = seen["__label"].where(seen["__label"] == PROSE, "other").to_numpy()
    prose = induce(columns, found, columns["chars"].clip(max=3000), order=[PROSE, "other"], sides=SIDES, pure=0.02, least_worth=0.7)
    whole = _texts(read.df, F.min("__label").alias("__label")).where(F.col("__label") != PROSE).select(F.xxhash64("key").alias("__draw"), "key", "__label", *TEXT_FEATURES)
    others = whole.orderBy("__draw", "key").limit(LABELLED_DOCUMENTS).toPandas()
    read.drop()
    there = [k for k in KINDS if (others["__label"] == k).any()] or list(KINDS[-1:])
    kinds = induce({f: others[f].to_numpy(float) for f in TEXT_FEATURES}, others["__label"].to_numpy(), np.ones(len(others)), order=there, least_worth=0.6, least_share=0.005)
    return Forms(prose, kinds if len(others) else Forms().texts)


def statistics(documents: DataFrame, key: str, text: str, forms: Forms) -> DataFrame:
    """One row for each document: key, words, mean_word_length, symbol_ratio, punctuated_lines, common_words, prose_share, form.

    `form` is PROSE if at least half of the characters (white space not counted) stand
    in units of prose, else one of KINDS. A word is a run of letters, in Han and kana
    each letter, as in `RUN`; an apostrophe inside a word counts as a letter. 'blank'
    for null, empty and blank texts, whose shares are null and counts 0. Keys should be
    unique; rows with the same key are counted together. The texts are read once, and a
    text's units are added up where they are read.
    """
    judged = units(documents, key, text).withColumn("kind", F.expr(forms.units.sql()))
    sums = _texts(judged, F.sum(F.when(F.col("kind") == PROSE, F.col("chars")).otherwise(0)).cast("long").alias("prose"))
    of = lambda part, whole: F.when(F.col("chars") > 0, part / F.greatest(whole, F.lit(1)))
    return sums.select(
        F.col("key").alias(key),
        "words",
        of(F.col("n_letters"), F.col("words")).alias("mean_word_length"),
        of(F.col("chars") - F.col("n_letters") - F.col("n_digits"), F.col("chars")).alias("symbol_ratio"),
        F.when(F.col("chars") > 0, F.least(F.col("ended_lines"), F.lit(1.0))).alias("punctuated_lines"),
        of(F.col("n_common"), F.col("words")).alias("common_words"),
        of(F.col("prose"), F.col("chars")).alias("prose_share"),
        F.when(F.col("chars") == 0, "blank").when(F.col("prose") * 2 >= F.col("chars"), PROSE).otherwise(F.expr(forms.texts.sql())).alias("form"),
    )
