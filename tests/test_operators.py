import random
import re
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from claimgraph.functions import text
from claimgraph.operators import audits, claims, planner, sections, vectors, visits, weighted
from claimgraph.sources import archive, records
from claimgraph.streaming import visits as stream


def test_records_keep_the_latest_version(spark):
    rows = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (1, "new", 2), (2, "x", None), (2, "y", 0), (None, "z", 5)], "id long, v string, updated_at long")
    assert {(r.id, r.v) for r in records(rows).collect()} == {(1, "new"), (2, "y")}
    assert records(rows.limit(0), "v").count() == 0


def test_terms(spark):
    cases = {
        '"a"': ["a"], '["x", 7, null, "y"]': ["x", "y"], '{"designation":"d","name":"n"}': ["d"], '{"name":"n"}': ["n"], '[{"designation":"e"},"z"]': ["e", "z"],
        "7": [], "true": [], "null": [], "bad": [], "[]": [], "{}": [], '"[\\"x\\"]"': ['["x"]'], '[["deep"]]': ["deep"], '{"designation":3}': [],
    }
    rows = spark.createDataFrame([*((k,) for k in cases), (None,)], "v string").select("v", text.terms(F.col("v")).alias("t")).collect()
    assert {r.v: r.t for r in rows if r.v is not None} == cases and [r.t for r in rows if r.v is None] == [[]]


def test_text_functions(spark):
    def fnv(s):
        h = 2166136261
        for b in s.encode():
            h = ((h ^ b) * 16777619) & 0xFFFFFFFF
        return h

    words = ["", "a", "Kéy 漢", "x" * 300]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.fnv1a(F.col("w")).alias("h"), text.shortened(F.col("w"), 5).alias("s"), text.folded(F.col("w")).alias("f")).collect()
    assert all(r.h == fnv(r.w) for r in got) and got[3].s == "xxxxx…" and got[2].f == "kéy 漢"
    loose = ['```json\n{"a":1}\n```', 'so: {"a":1} ok', '"{\\"a\\":1}"', "nothing", None]
    assert [r.j for r in spark.createDataFrame([(x,) for x in loose], "t string").select(text.loose_json(F.col("t")).alias("j")).collect()] == ['{"a":1}', '{"a":1}', '{"a":1}', None, None]


def test_profile_and_percentiles_against_brute_force(spark):
    r = random.Random(5)
    rows = [("hot" if r.random() < 0.7 else r.choice("abc"), r.choice([None, *range(40)])) for _ in range(3000)] + [(None, 1), ("empty", None)]
    compressed = weighted.frequencies(spark.createDataFrame(rows, "k string, v int"), ["k"], "v")
    got = {x.k: x for x in weighted.profile(compressed, ["k"]).collect()}
    ranks = {x.k: x for x in weighted.percentiles(compressed, ["k"], (0.0, 0.5, 0.9, 1.0), ("least", "p50", "p90", "most")).collect()}
    for k in {x for x, _ in rows}:
        held = sorted(v for q, v in rows if q == k and v is not None)
        all_ = [v for q, v in rows if q == k]
        assert (got[k].n, got[k].n_null, got[k].n_distinct) == (len(all_), all_.count(None), len(set(held)))
        if not held:
            assert got[k].mode is None and k not in ranks
            continue
        top = Counter(held)
        assert got[k].mode == min(v for v in top if top[v] == max(top.values()))
        at = lambda p: next(v for i, v in enumerate(held, 1) if i >= p * len(held))  # noqa: E731, B023
        assert (ranks[k].least, ranks[k].p50, ranks[k].p90, ranks[k].most) == (held[0], at(0.5), at(0.9), held[-1])
    assert weighted.profile(compressed.limit(0), ["k"]).count() == 0
    assert {x.k for x in weighted.heavy(weighted.profile(compressed, ["k"]), 2).collect()} == {"hot"}


def dice(a, b):
    if a == b:
        return 1.0
    squeezed = (re.sub(r"\s+", " ", s.lower()) for s in (a, b))
    x, y = (Counter(t[i : i + 2] for i in range(len(t) - 1)) for t in squeezed)
    return 2 * sum((x & y).values()) / (sum(x.values()) + sum(y.values())) if x and y else 0.0


def test_similarity(spark):
    pairs = [(1, "night", "nacht"), (2, "same", "same"), (3, "a", "ab"), (4, "", "xy"), (5, "aaaa", "aaab"), (6, "Ab  cd", "ab cd")]
    got = {r.id: r.similarity for r in claims.similarities(spark.createDataFrame(pairs, "id int, a string, b string"), "id", "a", "b").collect()}
    assert got == {i: pytest.approx(dice(a, b)) for i, a, b in pairs}


def log(spark):
    t = lambda n: datetime(2030, 1, n)
    rows = [
        (1, "W", "1", None, "k", '"a"', "superseded", False, 2, 10, t(1), t(2)),
        (2, "W", "1", None, "k", '"b"', "draft", False, None, 11, t(2), t(2)),
        (3, "W", "1", None, "gone", '"c"', "superseded", False, None, 11, t(2), t(3)),
        (4, "W", "1", None, "held", '"d"', "verified", True, None, None, t(1), t(1)),
        (5, "W", "1", None, "lost", '"e"', "superseded", False, 99, 10, t(1), t(1)),
    ]
    return spark.createDataFrame(rows, "id long, tendable_type string, tendable_id string, context_id long, key string, value string, status string, locked boolean, superseded_by_id long, visit_id long, created_at timestamp_ntz, updated_at timestamp_ntz")


def test_state_at_and_diff(spark):
    rows = log(spark)
    at = lambda n: {r.id for r in claims.state_at(rows, datetime(2030, 1, n)).collect()}
    assert (at(1), at(2), at(4)) == ({1, 4, 5}, {2, 3, 4, 5}, {2, 4, 5})
    diff = {(r.key, r.kind) for r in claims.state_diff(claims.state_at(rows, datetime(2030, 1, 1)), claims.state_at(rows, datetime(2030, 1, 4))).collect()}
    assert diff == {("k", "changed")}
    assert claims.state_diff(rows.limit(0), rows.limit(0)).count() == 0


def test_reconcile(spark):
    asked = [("k", "update", '"z"'), ("k", "DELETE", None), ("held", "DELETE", None), ("new", None, '"n"'), ("blank", "NOOP", '""'), ("absent", "DELETE", None), ("k", None, '"y"'), ("fresh", "UPDATE", "5")]
    kinds = "tendable_type string, tendable_id string, context_id long, key string, op string, value string, id int"
    proposed = spark.createDataFrame([("W", "1", None, k, op, v, i) for i, (k, op, v) in enumerate(asked)], kinds)
    got = [(r.key, r.op, r.live_id) for r in sorted(claims.reconcile(log(spark), proposed).collect(), key=lambda r: r.id)]
    # Each proposal of a key meets what the ones before it have left.
    assert got == [("k", "UPDATE", 2), ("k", "DELETE", None), ("held", "NOOP", 4), ("new", "ADD", None), ("blank", "NOOP", None), ("absent", "NOOP", None), ("k", "ADD", None), ("fresh", "ADD", None)]
    twice = [("k", "ADD", '"q"'), ("held", "ADD", '"q"'), ("held", "UPDATE", '"r"'), ("new", "ADD", '""'), ("new", "odd", None)]
    proposed = spark.createDataFrame([("W", "1", None, k, op, v, i) for i, (k, op, v) in enumerate(twice)], kinds)
    got = [(r.key, r.op, r.live_id) for r in sorted(claims.reconcile(log(spark), proposed).collect(), key=lambda r: r.id)]
    assert got == [("k", "ADD", 2), ("held", "ADD", 4), ("held", "UPDATE", None), ("new", "ADD", None), ("new", "UPDATE", None)]


def test_accuracy_precedence(spark):
    t = lambda n: datetime(2030, 1, n)
    a = spark.createDataFrame(
        [(1, 1, "examiner", "supported", t(3)), (2, 1, "human", "contradicted", t(1)), (3, 2, "examiner", "unverifiable", t(1)), (4, 4, "examiner", "supported", t(1)), (5, 4, "agent", "unsupported", t(9))],
        "id long, claim_id long, source string, verdict string, created_at timestamp_ntz",
    )
    assert {r.claim_id: r.verdict for r in audits.effective(a).collect()} == {1: "contradicted", 2: "unverifiable", 4: "supported"}
    held = log(spark).withColumn("tier", F.lit(None).cast("string"))
    v = spark.createDataFrame([(10, "summary"), (11, "summary")], "id long, facet string")
    cell = {r.facet: r for r in audits.accuracy(a, held, v).collect()}
    assert (cell["summary"].audited, cell["summary"].live, cell["summary"].supported_rate) == (2, 1, 0.0)
    assert (cell["host"].tier, cell["host"].supported_rate) == ("unknown", 1.0)
    agreed = audits.agreement(a).first()
    assert (agreed.overlaps, agreed.agreements, agreed.rate, agreed.overruled_supported) == (1, 0, None, 1)


def test_spend_and_estimates(spark):
    t = lambda n: datetime(2030, 1, n)
    rows = [(1, "summary", "cheap", 1000, 200, 1200, "succeeded", True, t(1)), (2, "summary", None, 200, 100, 300, "succeeded", False, t(2)), (3, "critique", "quality", None, 50, None, "failed", False, t(3))]
    v = spark.createDataFrame(rows, "id long, facet string, tier string, tokens_input long, tokens_output long, tokens_total long, status string, applied boolean, created_at timestamp_ntz")
    got = {(r.facet, r.tier): r.tokens_total for r in visits.spend(v).collect()}
    assert got == {("summary", "cheap"): 1200, ("summary", "unknown"): 300, ("summary", None): 1500, ("critique", "quality"): 0, ("critique", None): 0}
    assert {r.facet: r.est for r in visits.estimates(v).collect()} == {"summary": 1500, "critique": 1500}
    assert visits.estimates(v.limit(0)).count() == 0


def test_sections_changes_and_quotes(spark):
    d = spark.createDataFrame([(1, "ab\ncd\n\ne"), (2, ""), (3, None)], "id int, text string")
    s = sections.sections(d, "id", "text")
    assert [(r.id, r.ordinal, r.text, r.char_start, r.char_end) for r in s.orderBy("id", "ordinal").collect()] == [(1, 0, "ab", 0, 2), (1, 1, "cd", 2, 4), (1, 2, "", 4, 4), (1, 3, "e", 4, 5), (2, 0, "", 0, 0)]
    later = sections.sections(spark.createDataFrame([(1, "ab\nXX")], "id int, text string"), "id", "text")
    assert {(r.id, r.ordinal, r.change) for r in sections.changes(s, later, "id").collect()} == {(1, 0, "kept"), (1, 1, "updated"), (1, 2, "deleted"), (1, 3, "deleted"), (2, 0, "deleted")}
    q = spark.createDataFrame([(1, "one two. three four one.three two", ["one", "two", "three"]), (2, "none", ["x"])], "id int, t string, w array<string>")
    assert [(r.id, r.start, r.span) for r in sections.tightest(q, "id", "t", "w").collect()] == [(1, 0, 9)]


def test_knn_against_brute_force(spark):
    import numpy as np

    r = np.random.default_rng(2)
    m = r.normal(size=(60, 5))
    m[7] = m[3]
    rows = spark.createDataFrame([(i, m[i].astype("float32").tolist()) for i in range(60)] + [(99, None), (98, []), (97, [0.0] * 5)], "id long, v array<float>")
    got = {}
    for x in vectors.knn(rows, "id", "v", rows.where("id % 10 = 0 OR id = 97"), 4).collect():
        got.setdefault(x.query, []).append((x.place, x.id))
    u = m.astype("float32").astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    for q in range(0, 60, 10):
        far = sorted((round(1 - float(u[q] @ u[i]), 9), i) for i in range(60) if i != q)[:4]
        assert [i for _, i in sorted(got[q])] == [i for _, i in far]
    assert 97 not in got
    assert vectors.knn(rows.limit(0), "id", "v", rows.limit(0), 3).count() == 0


def test_archive_round_trip_and_upserts(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id long, v string, at long")
    archive.export({"things": rows}, f"file://{tmp_path}/x")
    back = archive.load(spark, f"file://{tmp_path}/x", {"things": ["id", "v"]})["things"]
    assert sorted(map(tuple, back.collect())) == [(1, "a", 1), (2, "b", 1)]
    with pytest.raises(ValueError):
        archive.load(spark, f"file://{tmp_path}/x", {"things": ["missing"]})
    new = spark.createDataFrame([(2, "B", 1), (3, "c", 0), (3, "c", 0)], "id long, v string, at long")
    assert sorted(map(tuple, archive.upsert(rows, new, ["id"], "at").collect())) == [(1, "a", 1), (2, "B", 1), (3, "c", 0)]
    assert [r.id for r in archive.insert_missing(rows, new, ["id"]).collect()] == [3]
    assert sorted(map(tuple, archive.update_only(rows, new.dropDuplicates(), ["id"], ["v"]).collect()), key=str) == [(1, "a", 1), (2, "B", 1), (3, "c", None)]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, "W", str(i % 3), "f", "succeeded", i, datetime(2030, 1, 1 + i // 5, i % 24)) for i in range(40)]
    v = spark.createDataFrame(rows, "id long, tendable_type string, tendable_id string, facet string, status string, tokens_total long, created_at timestamp_ntz")
    v.write.parquet(f"file://{tmp_path}/in")
    live = spark.readStream.schema(v.schema).parquet(f"file://{tmp_path}/in")
    stream.to_table(stream.per_window(live), f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination()
    done = {tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    batch = {tuple(r) for r in stream.per_window(v).collect()}
    assert done and done < batch and len(batch - done) <= 3  # the newest windows wait for the watermark
    assert sum(r.visits for r in stream.sessions(v).collect()) == 40


def test_budget_is_dealt(spark):
    assert planner.greedy([(5, 10), (9, 30), (4, 7)], 125) == [5, 2, 2]
    assert planner.fair([(2, 10), (100, 10)], 200) == [2, 18]
    assert planner.fair([(5, 40), (5, 30)], 59) == [1, 0] and planner.fair([], 10) == [] and planner.fair([(3, 5)], 0) == [0]
    r = random.Random(8)
    for _ in range(200):
        lanes, budget = [(r.randrange(20), r.randrange(1, 50)) for _ in range(r.randrange(1, 6))], r.randrange(400)
        for deal in (planner.fair, planner.greedy):
            got = deal(lanes, budget)
            assert sum(k * c for k, (_, c) in zip(got, lanes)) <= budget and all(0 <= k <= n for k, (n, _) in zip(got, lanes))
    rows = spark.createDataFrame([("a", i, 10) for i in range(2)] + [("b", i, 10) for i in range(100)] + [(None, 1, 500)], "lane string, i int, cost int")
    got = planner.planned(rows, "lane", "cost", [F.col("i")], 300).collect()
    assert Counter(x.lane for x in got) == {"a": 2, "b": 28}
    assert all(x.place == x.i + 1 for x in got)
    assert planner.planned(rows.limit(0), "lane", "cost", [F.col("i")], 300).count() == 0
