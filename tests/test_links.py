"""Links, batches, search scores: nulls, ties, repeated rows, empty tables."""

import random

from pyspark.sql import functions as F

from strataloom.operators import graph, links, relational, retrieval, symbols


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_merged_and_dominant_edges(spark):
    e = spark.createDataFrame([("a", "b", "x", 2), ("a", "b", "y", 1), ("b", "a", "x", 3), ("a", "a", "x", 9), ("c", "d", "x", None), ("d", "c", "x", None)], "src string, dst string, kind string, weight int")
    priority = F.when(F.col("kind") == "y", 2).otherwise(1)
    merged = links.merged_edges(e, ["src", "dst"], "kind", priority)
    assert rows(merged, "src", "dst", "weight", "kind") == [("a", "a", 9, "x"), ("a", "b", 3, "y"), ("b", "a", 3, "x"), ("c", "d", 0, "x"), ("d", "c", 0, "x")]
    assert rows(links.dominant(merged), "src", "dst") == [("a", "b"), ("c", "d")]
    assert links.merged_edges(e.limit(0), ["src", "dst"], "kind", priority).isEmpty()


def test_usage_and_catalogue(spark):
    used = spark.createDataFrame([("a",), ("a",), ("a/b",), ("c/d",), ("c/e/f",), (None,)], "spec string")
    names = spark.createDataFrame([("a",), ("c",), ("x",), ("a",)], "name string")
    assert rows(links.usage(names, used), "name", "uses") == [("a", 2), ("c", 2), ("x", 0)]
    catalogue = spark.createDataFrame([("c",), ("c/e",), ("c/e",)], "entry string")
    assert rows(links.catalogued(used.where("spec is not null").distinct(), "spec", catalogue), "spec", "entry") == [("c/d", "c"), ("c/e/f", "c/e")]


def test_uncontained_against_brute_force(spark):
    r = random.Random(3)
    spans = [(k, "p", a := r.randrange(1, 2000), a + r.choice([0, 3, 700])) for k in range(120)] + [(900, "p", None, 4), (901, "p", 9, 3)]
    df = spark.createDataFrame(spans, "id int, file string, s int, e int")
    ok = [x for x in spans if x[2] is not None]
    kept = {x[0] for x in spans if x[2] is None or not any(o[0] < x[0] and o[2] <= o[3] and o[2] <= x[2] and o[3] >= x[3] for o in ok)}
    assert {x.id for x in links.uncontained(df, ["file"], "s", "e", "id").collect()} == kept


def test_clusters_through_chains(spark):
    items = spark.createDataFrame([(f"n{k:02}",) for k in range(12)] + [("n00",)], "id string")
    chain = spark.createDataFrame([(f"n{k:02}", f"n{k + 1:02}") for k in (5, 3, 1, 4, 2)] + [("n09", "n08"), ("n08", "n09"), (None, "n01")], "a string, b string")
    found = dict(rows(links.clusters(items, "id", chain), "id", "cluster"))
    assert [found[f"n{k:02}"] for k in (1, 4, 6)] == ["n01"] * 3 and found["n09"] == "n08" and found["n00"] == "n00" and len(found) == 12


def test_previous_version(spark):
    v = [("a", None, True, "zip", None, "x", 1), ("b", None, False, "zip", None, "x", 2), ("c", "b", True, "zip", None, "x", 3), ("d", "a", False, "git", "u", "x", 4), ("e", None, True, "git", "u", "x", 5)]
    df = spark.createDataFrame(v, "id string, named string, ready boolean, source_type string, source_url string, name string, created_at int")
    assert rows(links.previous_version(df), "id", "previous") == [("a", None), ("b", "a"), ("c", "a"), ("d", "a"), ("e", None)]


def test_pack_against_a_fold(spark):
    r = random.Random(1)
    data = [(k, i, r.choice([None, 0, 3, 40, 120])) for k in ("a", None, "b") for i in range(60)]
    got = {(x.k, x.i): x.batch for x in relational.pack(spark.createDataFrame(data, "k string, i int, s int"), ["k"], "i", "s", 100).collect()}
    for k in ("a", None, "b"):
        used = batch = 0
        for kk, i, s in data:
            if kk == k:
                if used and used + (s or 0) > 100:
                    used, batch = 0, batch + 1
                used += s or 0
                assert got[(k, i)] == batch
    assert relational.pack(spark.createDataFrame([], "k string, i int, s int"), ["k"], "i", "s", 9).isEmpty()


def test_resolved_by_tiers(spark):
    e = spark.createDataFrame([("p", "x", "p/1"), ("p", "x", "p/2"), ("q", "x", "q/1"), ("q", "y", "q/2"), ("r", None, "r/1")], "project string, name string, own string").distinct()
    got = rows(relational.resolved(e, "own", [["project", "name"], ["name"]]), "own", "target", "tier")
    assert got == [("p/1", "p/2", 1), ("p/2", "p/1", 1), ("q/1", "p/1", 2)]


def test_states_and_pieces(spark):
    p = spark.createDataFrame([("s", 0, 5), ("s", 5, 5), ("s", 5, 5), ("s", 12, 3), ("t", 4, 1)], "k string, start int, size int")
    assert rows(relational.reassembled(p, "k", "start", "size"), "k", "received", "length", "gaps") == [("s", 13, 15, 1), ("t", 1, 5, 1)]
    s = spark.createDataFrame([("j", "a", 1), ("j", "b", 2), ("j", "b", 3), ("j", "a", 4)], "id string, state string, at int")
    assert rows(relational.transitions(s, "id", "state", ["at"], [("a", "b")]), "before", "state", "allowed") == [("a", "b", True), ("b", "a", False)]


def test_search_scores(spark):
    best = spark.createDataFrame([(1, 10, 2.0, 1), (1, 11, 1.0, 1)], "query_id int, id int, score double, matched long")
    entries = spark.createDataFrame([(10, None), (11, "The cache of x")], "id int, title string")
    asked = spark.createDataFrame([(1, "cache", "cache of"), (1, "ledger", "cache of"), (1, "cache", "cache of")], "query_id int, term string, phrase string")
    assert rows(retrieval.boosted(best, entries, "id", "title", asked), "id", "score", "rank") == [(10, 1.5, 2), (11, 6.2, 1)]
    similar = spark.createDataFrame([(1, 11, 0.5), (1, 12, 0.2), (1, 13, 0.9)], "query_id int, id int, similarity double")
    weights = spark.createDataFrame([(10, 1.0), (13, None)], "id int, importance double")
    assert rows(retrieval.blended(best, similar, weights), "id", "score") == [(10, 1.25), (11, 0.9), (13, 0.7200000000000001)]
    names = spark.createDataFrame([("f", "Ab", 0.1), ("g", "ab", 0.9), ("h", None, 1.0)], "id string, name string, importance double")
    wanted = spark.createDataFrame([(1, "Ab"), (2, "AB"), (3, "zz")], "query_id int, name string")
    assert rows(retrieval.looked_up(names, wanted), "query_id", "id", "exact") == [(1, "f", True), (2, "g", False)]


def test_layers_and_headings(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("z", "a"), ("c", "z")], "src string, dst string")
    assert rows(graph.layers(e, "a", 2), "node", "layer") == [("a", 0), ("b", 1), ("c", -2), ("z", -1)] or rows(graph.layers(e, "a", 2), "node", "layer") == [("a", 0), ("b", 1), ("c", 2), ("z", -1)]
    t = spark.createDataFrame([(1, "# A\n## B\n### C\n## D\ntext\n# E\n### F"), (2, None), (3, "none")], "id int, content string")
    assert rows(symbols.nested(t), "line_no", "parent_line") == [(1, None), (2, 1), (3, 2), (4, 1), (6, None), (7, 6)]
