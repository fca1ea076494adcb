"""Components against a plain union, hubs included."""

import numpy as np

from tidemark.operators import graphs, network, packed


def plain(pairs):
    root = {}

    def top(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {x: top(x) for x in root}


def test_components_match_a_plain_union(spark):
    rng = np.random.default_rng(4)
    chain = [(i, i + 1) for i in range(0, 60)]
    hub = [(5000, int(x)) for x in rng.permutation(np.arange(1000, 1900))]  # a centre larger than its leaves
    low_hub = [(2000, int(x)) for x in range(2001, 2700)]
    loose = [(int(a), int(b)) for a, b in rng.integers(6000, 6300, (120, 2))]
    pairs = chain + hub + low_hub + loose + [(7000, 7000)] + chain[:5]
    got = graphs.connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()
    assert {r["node"]: r["component"] for r in got} == plain(pairs) and len(got) == len(plain(pairs))
    names = [(f"n{a}", f"n{b}") for a, b in hub[:300] + loose]
    got = graphs.connected_components(spark.createDataFrame(names, "src string, dst string")).collect()
    assert {r["node"]: r["component"] for r in got} == plain(names)
    assert graphs.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_a_hubs_rows_do_not_meet(spark):
    rows = spark.createDataFrame([(1, i) for i in range(2000)] + [(k, 0) for k in range(2, 50)], "hi long, lo long")
    values = rows.groupBy("hi").count().withColumnRenamed("count", "n").selectExpr("hi", "hi * 10 as m", "n")
    out = graphs.spread_join(rows, "hi", values, 2048)
    assert out.count() == 2048 and out.where("m <> hi * 10").isEmpty()
    assert "BroadcastHashJoin" in out._jdf.queryExecution().toString()


def score(pairs, weight, label, resolution):
    inside = sum(w for (i, j), w in zip(pairs, weight) if label[i] == label[j])
    return inside - resolution * sum(k * (k - 1) / 2 for k in np.bincount(label))


def test_communities_are_connected_and_no_single_move_gains():
    rng = np.random.default_rng(0)
    for seed in range(6):
        n = 60
        group = rng.integers(0, 5, n)
        pairs = [(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < (0.6 if group[i] == group[j] else 0.05)]
        weight = rng.random(len(pairs)) + 0.5
        label = graphs.potts(n, *np.array(pairs).T, weight, 0.3)
        base = score(pairs, weight, label, 0.3)
        assert base >= 0.95 * score(pairs, weight, group, 0.3)  # a local optimum: near the planted groups, not always above them
        for v in range(n):
            for c in set(label.tolist()):
                other = label.copy()
                other[v] = c
                assert score(pairs, weight, other, 0.3) <= base + 1e-9
        for c in set(label.tolist()):
            members = set(np.flatnonzero(label == c).tolist())
            inner = [(i, j) for i, j in pairs if i in members and j in members]
            assert len(members) == 1 or len(set(plain(inner).values())) == 1 and set(plain(inner)) == members


def planted(seed, n=60, groups=5, inside=0.6, outside=0.05):
    rng = np.random.default_rng(seed)
    group = rng.integers(0, groups, n)
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < (inside if group[i] == group[j] else outside)]
    return group, pairs, rng.integers(2, 9, len(pairs)).tolist()


def test_a_large_component_is_optimised_in_blocks_and_its_edges_are_no_rows(spark, monkeypatch):
    monkeypatch.setattr(packed, "ALONE", 50)
    monkeypatch.setattr(packed, "EDGES", 100)
    monkeypatch.setattr(packed, "BLOCK", 120)
    name = lambda i: f"n{i:03d}"
    for seed, resolution in ((1, 1.0), (2, 0.5), (3, 2.5)):
        group, pairs, weight = planted(seed)
        ring = [(900, 901, 3), (901, 902, 3), (900, 902, 3)]  # a small component beside the large one
        rows = [(name(a), name(b), w) for (a, b), w in zip(pairs, weight)]
        rows = [r if i % 2 else (r[1], r[0], r[2]) for i, r in enumerate(rows)] + [(name(a), name(b), w) for a, b, w in ring] + [(None, "n000", 3), ("n000", "n000", 3)]
        graph = packed.pack(spark.createDataFrame(rows, "src string, dst string, weight long"))
        assert graph.rows.count() < len(rows) / 10
        got = packed.communities(graph, [resolution])[0].collect()
        of = {r["author_id"]: r["cluster_id"] for r in got}
        assert len(of) == len(got) and {of[name(i)] for i in (900, 901, 902)} == {"n900"}
        label = np.unique([of.get(name(i), name(i)) for i in range(60)], return_inverse=True)[1]
        base = score(pairs, weight, label, resolution)
        alone = graphs.potts(60, *np.array(pairs).T, np.array(weight, float), resolution)
        assert base >= 0.95 * max(score(pairs, weight, group, resolution), score(pairs, weight, alone, resolution))
        for v in range(60):
            for c in [*set(label.tolist()), 60]:
                other = label.copy()
                other[v] = c
                assert score(pairs, weight, other, resolution) <= base + 1e-6
        for c in set(label.tolist()):
            members = set(np.flatnonzero(label == c).tolist())
            inner = [(i, j) for i, j in pairs if i in members and j in members]
            assert len(members) == 1 or len(set(plain(inner).values())) == 1 and set(plain(inner)) == members
            assert min(np.flatnonzero(label == c)) == int(of.get(name(min(members)), name(min(members)))[1:])


def test_sums_between_clusters_come_from_packed_edges(spark):
    _, pairs, weight = planted(7)
    edges = spark.createDataFrame([(f"n{a}", f"n{b}", w) for (a, b), w in zip(pairs, weight)], "src string, dst string, weight long")
    members = spark.createDataFrame([(f"n{i}", f"c{i % 4}") for i in range(50)], "author_id string, cluster_id string")
    one, two = (sorted(map(tuple, network.cluster_summary(e, members).collect())) for e in (edges, packed.pack(edges)))
    assert one == two and len(one) == 4
