from claimgraph.operators import graph, scope, vocabulary


def test_metrics_and_additions(spark):
    rows = [("1", "a", "x", "approved", None), ("1", "b", "x", "approved", None), ("2", "a", "y", "approved", None), ("1", "a", "v", "mapped", "x"), ("2", "b", "v", "mapped", "x"), ("2", "b", "v", "mapped", "y"), ("3", "b", "p", "pending", None)]
    s = spark.createDataFrame([("W", *r) for r in rows], "tendable_type string, tendable_id string, facet string, proposed_key string, status string, mapped_to string")
    assert tuple(vocabulary.metrics(s).first()) == (4, 2, 2, 3, 1.0, 75)
    assert tuple(vocabulary.metrics(s.limit(0)).first()) == (0, 0, 0, 0, None, None)
    assert {tuple(r) for r in vocabulary.additions(s).collect()} == {("a", "x,y"), ("b", "x")}
    assert {r.proposed_key for r in vocabulary.resolved(s).collect()} == {"x", "y", "v"} and vocabulary.synonyms(s).count() == 3


def test_parts_roll_up_to_parents(spark):
    rows = spark.createDataFrame([("Enliterator::Part", "1", 5), ("Enliterator::Part", "2", 6), ("W", "1", 7)], "tendable_type string, tendable_id string, n int")
    parts = spark.createDataFrame([(1, "W", "9")], "id long, record_type string, record_id string")
    assert {tuple(r) for r in scope.to_parents(rows, parts).collect()} == {("W", "9", 5), ("Enliterator::Part", "2", 6), ("W", "1", 7)}


def test_overview_fills_with_records(spark):
    edges = [("W/1", "context/1", "in-context", "context", 1.0), ("W/1", "W/2", "cites", "other", None), *((f"W/{i}", f"term/{i % 3}", "k", "other", 0.9) for i in range(100, 130)), ("W/7", "term/x", "k", "other", 0.1)]
    drawn = spark.createDataFrame(edges, "s string, t string, key string, category string, weight double")
    groups = spark.createDataFrame([("W/1", 1)], "node string, group long")
    kept = {r.node for r in graph.overview_nodes(drawn, groups, 12).collect()}
    assert "context/1" in kept and "W/1" in kept and len(kept) == 12
    kept = graph.overview_nodes(drawn, groups)
    assert {r.node for r in kept.collect()} == {n for e in edges for n in e[:2]} - {"term/x"}
    shown = [(r.s, r.t) for r in graph.overview(drawn, kept, 33).collect()]
    assert len(shown) == 32 and shown[-1] == ("W/1", "context/1") and shown[-2] == ("W/1", "W/2")
