"""All queries of the core, by name."""

from claimgraph.plans import collection, condition, dealt, store

QUERIES = {**store.QUERIES, **condition.QUERIES, **collection.QUERIES, **dealt.QUERIES}
SQL = {**store.SQL, **condition.SQL, **collection.SQL, **dealt.SQL}
