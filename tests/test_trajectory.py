from datetime import datetime

from claimgraph.operators import trajectory, visits as log

T = lambda n: datetime(2030, 1, n)


def _log(spark):
    read = [(10, "W", "1", "f", 1), (11, "W", "1", "f", 5), (12, "W", "1", "f", 9), (13, "W", "1", "g", 6), (14, "W", "1", "f", 7)]
    visits = spark.createDataFrame(
        [(i, t, r, f, "failed" if i == 14 else "succeeded", i != 14, 2, T(n)) for i, t, r, f, n in read],
        "id long, tendable_type string, tendable_id string, facet string, status string, applied boolean, n_updated int, created_at timestamp_ntz",
    )
    made = [
        (1, "k", '"one long sentence here"', "superseded", 2, 10, 2, 6), (2, "k", '"one long sentence here."', "superseded", 3, 11, 6, 7), (3, "k", '"z"', "superseded", 4, 14, 7, 10), (4, "k", '"one long sentence here."', "draft", None, 12, 10, 10),
        (5, "gone", '"x"', "superseded", None, 10, 2, 6), (6, "late", "null", "draft", None, 12, 10, 10), (7, "other", "1", "draft", None, 13, 7, 7), (8, "host", "1", "draft", None, None, 6, 6), (9, "brief", "1", "superseded", None, 11, 6, 8),
    ]
    claims = spark.createDataFrame(
        [(i, "W", "1", k, v, s, n, visit, T(a), T(b)) for i, k, v, s, n, visit, a, b in made],
        "id long, tendable_type string, tendable_id string, key string, value string, status string, superseded_by_id long, visit_id long, created_at timestamp_ntz, updated_at timestamp_ntz",
    )
    return visits, claims


def test_timeline_walks_visits_and_facets(spark):
    visits, claims = _log(spark)
    got = {(r.facet, r.visit_id, r.key, r.kind, r.from_id, r.to_id) for r in trajectory.timeline(visits, claims).collect()}
    assert got == {("f", 11, "k", "changed", 1, 3), ("f", 11, "gone", "deleted", 5, None), ("f", 12, "k", "changed", 3, 4), ("f", 12, "late", "added", None, 6)}
    assert trajectory.timeline(visits.limit(0), claims).count() == trajectory.timeline(visits, claims.limit(0)).count() == 0


def test_churn_of_passes(spark):
    visits, claims = _log(spark)
    claims = claims.where("id NOT IN (3)").replace({"draft": "asserted"})
    got = {r["pass"]: (r.updated, r.churned, r.churn_rate) for r in trajectory.compounding(visits, claims).collect()}
    assert got == {1: (4, 0, 0.0), 2: (2, 1, 0.5), 3: (2, 1, 0.5)}


def test_frontier_of_every_lane(spark):
    members = spark.createDataFrame([(7, "W", "1", T(1)), (7, "W", "2", T(1))], "context_id long, member_type string, member_id string, created_at timestamp_ntz")
    hosts = spark.createDataFrame([("W", "1"), ("W", "3")], "tendable_type string, tendable_id string")
    facets = spark.createDataFrame([("f",), ("g",)], "facet string")
    rows = [("W", "1", "f", 7, "succeeded", True), ("W", "1", "g", None, "succeeded", True), ("W", "3", "f", None, "failed", False)]
    v = spark.createDataFrame([(*r, T(5)) for r in rows], "tendable_type string, tendable_id string, facet string, context_id long, status string, applied boolean, created_at timestamp_ntz")
    wanted = log.lanes(members, facets, hosts)
    left = lambda *after: {(r.facet, r.context_id, r.member_id) for r in log.frontier_lanes(wanted, v, *after).collect()}
    assert left() == {("f", 7, "2"), ("g", 7, "1"), ("g", 7, "2"), ("f", None, "1"), ("f", None, "3"), ("g", None, "3")}
    assert left(T(4)) == left() - {("f", None, "3")} and left(T(5)) == left()
