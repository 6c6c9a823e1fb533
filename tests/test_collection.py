"""Small cases of briefs, name groups, survey queues, graph filters, text functions and dealing."""

import random
from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from claimgraph.functions import text
from claimgraph.operators import brief, graph, name_groups, planner, survey, vectors, weighted


def one(spark, column, *values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", column.alias("y")).orderBy("i").collect()]


def test_terms_of_any_depth(spark):
    got = one(spark, text.terms(F.col("x")), '["a",["b",["c",[[["d"]]]]]]', '[[], "e", {"name": "f"}]', '"g"', "[[[[1]]]]", "no json", None, "[]")
    assert got == [["a", "b", "c", "d"], ["e", "f"], ["g"], [], [], [], []]


def test_text_functions(spark):
    x = F.col("x")
    assert one(spark, text.clamped(x), "0.25", "7", "-1", "x", None) == [0.25, 1.0, 0.0, 0.5, 0.5]
    assert one(spark, text.token_count(x, "total"), '{"total": 12}', '{"total": null}', "{}", None, "x") == [12, 0, 0, 0, 0]
    assert one(spark, text.follow_ups(x, "NEXT:"), "Yes.\nNEXT:\n- Who?\n2. Why?\n\n* How?\nMore?", "none", None) == [["Who?", "Why?", "How?"], [], []]
    assert one(spark, text.loose_array(x), "[1, 2]", '```json\n{"claims": ["a"]}\n```', '"[3]"', '{"a": [1], "b": [2]}', "x", None) == [["1", "2"], ['"a"'], ["3"], None, None, None]
    assert one(spark, F.array_sort(text.significant(x)), "The harbour of 7 old reports, used by Harbour", None, "") == [["7", "harbour", "reports"], [], []]
    assert one(spark, text.plain_value(x), '"a b"', "5", '["c"]', None, "x") == ["a b", "5", '["c"]', None, "x"]


def test_names_are_grouped_or_held(spark):
    rows = [("Jordan L. Avery", 5), ("Jordan Avery (contractor)", 9), ("JORDAN L. AVERY, Ph.D.", 1), ("Ann B. Moor", 2), ("Ann C. Moor", 2), ("Thomas Frey", 3), ("Marcus Calloway", 3), ("Jordan Frey Marcus Calloway", 1), ("Plato", 4), ("Zoë Lé-Roux", 1), ("Zoe  Le - Roux", 1), (None, 2)]
    got = {r.canonical: (r.variants, r.status) for r in name_groups.groups(spark.createDataFrame(rows, "n string, f int"), "n", "f").collect()}
    assert got["Jordan L. Avery"] == (["JORDAN L. AVERY, Ph.D.", "Jordan Avery (contractor)", "Jordan L. Avery"], "auto")
    assert got["Ann B. Moor"] == (["Ann B. Moor", "Ann C. Moor"], "held") and got["Jordan Frey Marcus Calloway"] == (["Jordan Frey Marcus Calloway"], "held")
    assert got["Zoe  Le - Roux"] == (["Zoe  Le - Roux", "Zoë Lé-Roux"], "auto") and len(got) == 4
    assert name_groups.groups(spark.createDataFrame([], "n string, f int"), "n", "f").count() == 0


def test_survey_queue(spark):
    hosts = spark.createDataFrame([("A", str(i)) for i in range(9)] + [("B", "1"), ("C", "1"), ("C", "2")], "tendable_type string, tendable_id string")
    seen = spark.createDataFrame([("C", "1", datetime(2030, 1, 2)), ("Z", "9", datetime(2030, 1, 1))], "tendable_type string, tendable_id string, computed_at timestamp_ntz")
    first = {(r.tendable_type, r.tendable_id) for r in survey.due(hosts, seen, 6).collect()}
    assert first == {("A", "0"), ("A", "1"), ("B", "1"), ("C", "2"), ("A", "2"), ("A", "3")}
    rest = [(r.tendable_type, r.origin) for r in survey.due(hosts, seen, 12).collect() if r.origin == "stale"]
    assert rest == [("Z", "stale")]
    assert survey.due(hosts.limit(0), seen.limit(0), 3).count() == 0


def test_part_sessions(spark):
    visits = spark.createDataFrame([("Part", "p1", "s", "succeeded", "deep", 5), ("Part", "p2", "s", "failed", "deep", None), ("Part", "p9", "s", "succeeded", "deep", 1), ("Work", "w1", "s", "succeeded", "deep", 2), ("Work", "w1", "s", "succeeded", "deep", 2), ("Work", "w3", "s", "succeeded", None, 7)], "tendable_type string, tendable_id string, facet string, status string, reason string, tokens_total long")
    parents = spark.createDataFrame([("p1", "Work", "w1"), ("p2", "Work", "w2")], "part_id string, record_type string, record_id string")
    assert tuple(brief.sessions(visits, parents, "Part", "deep").first()) == (2, 2, 1, 1, 10)


def test_shares_are_exact(spark):
    rows = spark.createDataFrame([("g", i, 1) for i in range(1, 101)], "k string, value long, weight long")
    shares = (0.07, 0.14, 0.28, 0.55, 0.56, 1.0)
    assert list(weighted.percentiles(rows, ["k"], shares).first()[1:]) == [7, 14, 28, 55, 56, 100]


def test_takes_deal_as_fair(spark):
    r = random.Random(2)
    for _ in range(6):
        lanes, budget = [(r.randrange(1, 20), r.randrange(1, 50)) for _ in range(r.randrange(1, 6))], r.randrange(1, 400)
        frame = spark.createDataFrame([(f"l{i}", n, c) for i, (n, c) in enumerate(lanes)], "lane string, n long, cost long")
        got = {x.lane: x.take for x in planner.takes(frame, "lane", budget).collect()}
        assert [got.get(f"l{i}", 0) for i in range(len(lanes))] == planner.fair(lanes, budget)


def test_neighbours_among_ties_and_slices(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SLICE", 40)
    r = np.random.default_rng(3)
    v = r.integers(0, 3, (200, 4)).astype(float)  # many equal ones, some all zero
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    got = {(x["query"], x["id"]) for x in vectors.knn(frame, "id", "v", frame.where("id % 50 = 0"), 7).collect()}
    want = set()
    for q in range(0, 200, 50):
        if v[q].any():
            far = [(round(1 - v[q] @ v[i] / np.linalg.norm(v[q]) / np.linalg.norm(v[i]), 9), i) for i in range(200) if i != q and v[i].any()]
            want |= {(q, i) for _, i in sorted(far)[:7]}
    assert got == want


def test_graph_folds_and_filters(spark):
    claims = spark.createDataFrame(
        [(1, "W", "1", "subject", '"Water"'), (2, "W", "2", "subject", '["water", "Fire"]'), (3, "W", "3", "report_number", '"EO-7"'), (4, "W", "1", "cited_works", '"eo-7"'), (5, "W", "4", "call_number", '["eo-9"]'), (6, "W", "1", "related_work", '"EO-9"')],
        "id long, tendable_type string, tendable_id string, key string, value string",
    ).selectExpr("*", "0.5 + id / 10.0 AS confidence", "cast(null as long) AS superseded_by_id", "'draft' AS status", "1L AS visit_id", "'engine' AS attributed_to", "make_timestamp_ntz(2030, 1, cast(id as int), 0, 0, 0) AS created_at")
    members = spark.createDataFrame([], "context_id long, member_type string, member_id string, created_at timestamp_ntz")
    drawn = graph.edges(claims, members)
    assert {(r.s, r.t) for r in drawn.collect()} == {("W/1", "term/water"), ("W/2", "term/water"), ("W/2", "term/fire"), ("W/1", "W/3"), ("W/1", "term/eo-9")}
    assert {r.t for r in graph.filtered(drawn, 0.85).collect()} == {"W/3", "term/eo-9"}
    assert {r.t for r in graph.filtered(drawn, None, ["subject"], datetime(2030, 1, 2)).collect()} == {"term/water", "term/fire"}
    assert {r.term for r in graph.uncrowded(drawn, 2).collect()} == {"term/water"} and graph.uncrowded(drawn, 9).count() == 3
    assert graph.found(graph.nodes(drawn), "WATER").first().node == "term/water" and graph.found(graph.nodes(drawn), "none").count() == 0
