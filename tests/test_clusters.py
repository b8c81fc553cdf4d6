"""A6 complete linkage: brute force, edge cases, invariants."""

import hashlib
import itertools

import numpy as np
from pyspark.sql import functions as F

from newsweave.operators import clusters, vectors

KEYS = ["digest_date", "part"]


def brute_force(vecs: dict[int, np.ndarray], tau: float) -> set[frozenset]:
    """Sequential agglomeration: always merge the pair with the smallest
    complete-linkage distance (ties by smallest ids) while it is < tau."""
    unit = {i: v / np.linalg.norm(v) for i, v in vecs.items()}
    d = {(a, b): round(1 - float(np.dot(unit[a], unit[b])), 6) for a, b in itertools.combinations(sorted(unit), 2)}
    cl = {i: {i} for i in unit}
    while True:
        best = None
        for a, b in itertools.combinations(sorted(cl), 2):
            dm = max(d[(min(x, y), max(x, y))] for x in cl[a] for y in cl[b])
            key = (dm, a, b)
            if dm < tau and (best is None or key < best):
                best = key
        if best is None:
            return {frozenset(c) for c in cl.values()}
        _, a, b = best
        cl[a] |= cl.pop(b)


def rounds(vecs: dict[int, np.ndarray], tau: float, copies: dict[int, int] | None = None) -> tuple[set[frozenset], int]:
    """The defined rounds: all pairs that are each other's best by (distance,
    md5 of the ids, ids) merge at once. Clusters and number of rounds."""
    unit = {i: v / np.linalg.norm(v) for i, v in vecs.items()}
    cl = {i: {i} for i in unit}
    d = {frozenset((a, b)): round(1 - float(np.dot(unit[a], unit[b])), 6) for a, b in itertools.combinations(sorted(unit), 2)}
    n = 0
    while True:
        best: dict[int, tuple] = {}
        for a, b in itertools.combinations(sorted(cl), 2):
            dm = max(d[frozenset((x, y))] for x in cl[a] for y in cl[b])
            if dm < tau:
                key = (dm, hashlib.md5(f"{a},{b}".encode()).hexdigest(), a, b)
                for c in (a, b):
                    best[c] = min(best.get(c, key), key)
        merged = [k for c, k in best.items() if c == k[2] and best[k[3]] == k]
        if not merged:
            return {frozenset(c) for c in cl.values()}, n
        n += 1
        for _, _, a, b in merged:
            cl[a] |= cl.pop(b)


def spark_clusters(spark, groups: dict[tuple, dict[int, np.ndarray]], tau: float, block_rows=2000, local_max=0):
    data = [(k[0], k[1], i, [float(x) for x in v]) for k, g in groups.items() for i, v in g.items()]
    df = spark.createDataFrame(data, "digest_date string, part int, index long, vec array<double>")
    if local_max:
        out = clusters.view_stories(df.select(*KEYS, "index"), df.select("index", "vec"), threshold=tau,
                                    local_max=local_max).collect()
    else:
        edges = vectors.similar_pairs(df, tau, block_rows=block_rows)
        out = clusters.cluster_nodes(df.select(*KEYS, "index", F.lit(1).cast("long").alias("copies")), edges).collect()
    res: dict[tuple, dict[int, set]] = {}
    for r in out:
        res.setdefault((r["digest_date"], r["part"]), {}).setdefault(r["cid"], set()).add(r["index"])
    return {k: {frozenset(s) for s in v.values()} for k, v in res.items()}, out


def random_groups(seed: int, n_groups: int, n: int, dim: int = 6):
    rng = np.random.default_rng(seed)
    groups = {}
    for g in range(n_groups):
        centers = rng.normal(size=(max(2, n // 6), dim))
        pts = {}
        for i in range(n):
            c = centers[rng.integers(len(centers))]
            pts[seed * 100_000 + g * 1000 + i] = c + rng.normal(scale=0.35, size=dim)
        groups[(f"2024-01-{g + 1:02d}", 1 + g % 4)] = pts
    return groups


def test_matches_brute_force_random(spark):
    groups = {}
    for seed in range(3):
        for k, v in random_groups(seed, 3, 40).items():
            groups[(k[0][:-2] + f"{seed * 3 + int(k[0][-2:]):02d}", k[1])] = v
    got, _ = spark_clusters(spark, groups, 0.3)
    for k, pts in groups.items():
        assert got[k] == brute_force(pts, 0.3), k


def test_local_path_equals_distributed(spark):
    groups = {}
    for seed in range(3, 6):
        for k, v in random_groups(seed, 2, 50).items():
            groups[(k[0][:-2] + f"{seed * 2 + int(k[0][-2:]):02d}", k[1])] = v
    local, _ = spark_clusters(spark, groups, 0.3, local_max=10_000)
    dist, _ = spark_clusters(spark, groups, 0.3, local_max=0)
    assert local == dist
    for k, pts in list(groups.items())[:2]:
        assert local[k] == brute_force(pts, 0.3)


def test_blocked_pair_join_is_exact(spark):
    groups = random_groups(7, 2, 60)
    small, _ = spark_clusters(spark, groups, 0.3, block_rows=7)   # 9 blocks per slot
    whole, _ = spark_clusters(spark, groups, 0.3, block_rows=10_000)
    assert small == whole


def test_chain_is_not_one_cluster(spark):
    # a~b and b~c below 0.3, a~c above: complete linkage must not chain them
    a = np.array([1.0, 0.0])
    b = np.array([np.cos(0.62), np.sin(0.62)])
    c = np.array([np.cos(1.24), np.sin(1.24)])
    groups = {("2024-01-01", 1): {1: a, 2: b, 3: c}}
    got, _ = spark_clusters(spark, groups, 0.3)
    assert got[("2024-01-01", 1)] == brute_force(groups[("2024-01-01", 1)], 0.3)
    assert len(got[("2024-01-01", 1)]) == 2


def test_duplicates_singletons_and_empty(spark):
    v = np.array([0.3, 0.4, 0.5])
    groups = {("2024-01-01", 1): {1: v, 2: v.copy(), 3: v * 2},       # exact duplicates
              ("2024-01-02", 2): {4: np.array([1.0, 0.0, 0.0])},       # one article
              ("2024-01-03", 3): {5: np.array([1.0, 0.0, 0.0]), 6: np.array([0.0, 1.0, 0.0])}}
    got, out = spark_clusters(spark, groups, 0.3)
    assert got[("2024-01-01", 1)] == {frozenset({1, 2, 3})}
    assert got[("2024-01-02", 2)] == {frozenset({4})}
    assert got[("2024-01-03", 3)] == {frozenset({5}), frozenset({6})}
    by_cid: dict[int, set] = {}
    for r in out:
        by_cid.setdefault(r["cid"], set()).add(r["index"])
    assert all(cid == min(members) for cid, members in by_cid.items())


def test_distance_exactly_threshold_is_not_merged(spark):
    # cos = 0.7 -> distance exactly 0.3 after rounding: strict '<' keeps them apart
    a = np.array([1.0, 0.0])
    b = np.array([0.7, np.sqrt(1 - 0.49)])
    got, _ = spark_clusters(spark, {("2024-01-01", 1): {1: a, 2: b}}, 0.3)
    assert got[("2024-01-01", 1)] == {frozenset({1}), frozenset({2})}


def test_zero_vector_stays_alone(spark):
    groups = {("2024-01-01", 1): {1: np.array([0.0, 0.0]), 2: np.array([1.0, 0.0]), 3: np.array([1.0, 0.01])}}
    got, _ = spark_clusters(spark, groups, 0.3)
    assert got[("2024-01-01", 1)] == {frozenset({1}), frozenset({2, 3})}


def test_equal_distances_merge_many_pairs_a_round(spark):
    """Distinct vectors, all at distance 0 of each other: the hash order merges
    about a third of them in a round, the same ones in all three forms."""
    v = np.array([0.6, 0.8])
    groups = {("2024-01-01", 1): {i: v * i for i in range(1, 121)}}
    whole, n = rounds(groups[("2024-01-01", 1)], 0.3)
    assert len(whole) == 1 and n <= 20
    dist, _ = spark_clusters(spark, groups, 0.3)
    assert dist[("2024-01-01", 1)] == whole
    tied = {("2024-01-02", 2): {i: np.eye(6)[i % 6] + np.eye(6)[(i * 7 + 1) % 6] * (i % 3) for i in range(40)}}
    local, _ = spark_clusters(spark, tied, 0.3, local_max=1000)
    assert local[("2024-01-02", 2)] == rounds(tied[("2024-01-02", 2)], 0.3)[0]
    assert spark_clusters(spark, tied, 0.3)[0] == local


def test_copies_are_one_node(spark):
    """3,000 copies of a headline and one other article: two nodes, no pair."""
    rows = [("2024-01-01", 1, i) for i in range(3001)]
    members = spark.createDataFrame(rows, "digest_date string, part int, index long")
    vecs = members.select("index", F.when(F.col("index") < 3000, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(3)))
                          .alias("bag"), F.when(F.col("index") < 3000, F.array(F.lit(1.0), F.lit(0.0)))
                          .otherwise(F.array(F.lit(0.0), F.lit(1.0))).alias("vec"))
    _, nodes = clusters.view_nodes(members, vecs)
    assert sorted((r["index"], r["copies"]) for r in nodes.collect()) == [(0, 3000), (3000, 1)]
    for local_max in (0, 2000):
        got = clusters.view_stories(members, vecs, local_max=local_max)
        assert {(r["cid"], r["size"], r["label"]): r["count"] for r in got.groupBy("cid", "size", "label").count().collect()} \
            == {(0, 3000, 1): 3000, (3000, 1, 2): 1}


def test_weighted_copies_count_as_articles(spark):
    """Nodes that weigh several articles merge as their articles would."""
    rng = np.random.default_rng(11)
    base = {i: rng.normal(size=3) for i in range(12)}
    rows, vec_rows = [], []
    for i, v in base.items():
        for k in range(1 + i % 4):
            rows.append(("2024-01-01", 1, i * 10 + k))
            vec_rows.append((i * 10 + k, [i], [float(x) for x in v]))
    members = spark.createDataFrame(rows, "digest_date string, part int, index long")
    vecs = spark.createDataFrame(vec_rows, "index long, bag array<int>, vec array<double>")
    want = {frozenset(i for n in c for i in [r[2] for r in rows if r[2] // 10 == n // 10])
            for c in rounds({i * 10: v for i, v in base.items()}, 0.3)[0]}
    for local_max in (0, 2000):
        got: dict[int, set] = {}
        for r in clusters.view_stories(members, vecs, local_max=local_max).collect():
            got.setdefault(r["cid"], set()).add(r["index"])
        assert {frozenset(c) for c in got.values()} == want


def test_invariants_on_fixture(spark):
    """Every in-cluster pair of nodes is an edge (< tau); no two clusters of a
    slot could still merge; independent of the number of shuffle partitions."""
    from newsweave.plans import pipeline as pl
    d = "/root/testdata/sf0.001"
    sa = pl.build_story_articles(spark, d)
    edges = pl.pairs(spark, d)
    linked, nodes = clusters.view_nodes(pl.view_articles(spark, d), pl.headline_vectors(spark, d))
    assert linked.join(sa.select(*KEYS, "index", "cid"), [*KEYS, "index"]).groupBy(*KEYS, "node") \
        .agg(F.count_distinct("cid").alias("n")).where("n > 1").count() == 0
    members = nodes.select(*KEYS, "index").join(sa.select(*KEYS, "index", "cid"), [*KEYS, "index"])
    members = members.join(members.groupBy(*KEYS, "cid").agg(F.count("*").alias("size")), [*KEYS, "cid"])
    m2 = members.select(*KEYS, F.col("index").alias("b"), F.col("cid").alias("cid_b"))
    same = (members.join(m2, KEYS).where((F.col("cid") == F.col("cid_b")) & (F.col("index") < F.col("b")))
            .select(*KEYS, F.col("index").alias("a"), "b"))
    assert same.join(edges, [*KEYS, "a", "b"], "left_anti").count() == 0
    e = (edges.join(members.select(*KEYS, F.col("index").alias("a"), F.col("cid").alias("ca"), F.col("size").alias("sa")), [*KEYS, "a"])
         .join(members.select(*KEYS, F.col("index").alias("b"), F.col("cid").alias("cb"), F.col("size").alias("sb")), [*KEYS, "b"])
         .where(F.col("ca") != F.col("cb"))
         .groupBy(*KEYS, F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y"))
         .agg(F.count("*").alias("n"), F.first("sa").alias("sa"), F.first("sb").alias("sb")))
    assert e.where(F.col("n") == F.col("sa") * F.col("sb")).count() == 0
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        again = pl.build_story_articles(spark, d)
        a = {(r[0], r[1], r[2], r[3]) for r in sa.select(*KEYS, "index", "label").collect()}
        b = {(r[0], r[1], r[2], r[3]) for r in again.select(*KEYS, "index", "label").collect()}
        assert a == b
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_fused_views_equal_distributed_path(spark):
    groups = {}
    for seed in range(8, 11):
        for k, v in random_groups(seed, 2, 45).items():   # ids unique across seeds, as in the pipeline
            groups[(k[0][:-2] + f"{seed * 2 + int(k[0][-2:]):02d}", k[1])] = {
                seed * 10_000 + i: x for i, x in v.items()}
    rows = [(k[0], k[1], i) for k, g in groups.items() for i in g]
    rows.append(("2024-01-30", 1, 99_999))                     # article without a vector
    members = spark.createDataFrame(rows, "digest_date string, part int, index long")
    vec_rows = [(i, [float(x) for x in v]) for g in groups.values() for i, v in g.items()]
    vec_rows.append((99_998, [0.0] * 6))
    vecs = spark.createDataFrame(vec_rows, "index long, vec array<double>")
    cols = [*KEYS, "index", "cid", "size", "label"]
    fused = sorted(tuple(r) for r in clusters.view_stories(members, vecs, local_max=10_000).select(*cols).collect())
    dist = sorted(tuple(r) for r in clusters.view_stories(members, vecs, local_max=0).select(*cols).collect())
    assert fused == dist
    assert ("2024-01-30", 1, 99_999, 99_999, 1, 1) in fused
    for k, pts in list(groups.items())[:2]:
        got = {}
        for r in fused:
            if (r[0], r[1]) == k:
                got.setdefault(r[3], set()).add(r[2])
        assert {frozenset(s) for s in got.values()} == brute_force(pts, 0.3)


def test_tasks_finish_small_views_like_rounds(spark):
    """All rounds distributed, all in tasks, and a change on the way give equal clusters."""
    rng = np.random.default_rng(5)
    rows = []
    for v, n in enumerate((40, 15)):
        pts = rng.normal(size=(n, 3)).round(1) + 0.05
        u = pts / np.linalg.norm(pts, axis=1)[:, None]
        w = rng.integers(1, 4, n)
        d = np.round(1 - u @ u.T, 1)  # many equal distances
        rows += [(f"d{v}", 1, 3 * i, 3 * j, float(d[i, j]), int(w[i]), int(w[j]))
                 for i in range(n) for j in range(i + 1, n) if d[i, j] < 0.4]
    edges = spark.createDataFrame(rows, "digest_date string, part int, a long, b long, d double, wa long, wb long")
    got = [sorted(map(tuple, clusters.complete_linkage(edges, local_edges=k).collect())) for k in (0, len(rows) // 3, len(rows))]
    assert got[0] == got[1] == got[2] and len({r[3] for r in got[0]}) > 4


def test_few_jobs_for_a_long_chain_of_merges(spark, monkeypatch):
    """Rising distances allow one merge a round; the number of written tables must not follow."""
    n, names, write = 24, [], clusters._write
    monkeypatch.setattr(clusters, "_write", lambda df, name: (names.append(name), write(df, name))[1])
    rows = [("d", 1, i, j, j / 100, 1, 1) for i in range(n) for j in range(i + 1, n)]
    edges = spark.createDataFrame(rows, "digest_date string, part int, a long, b long, d double, wa long, wb long")
    got = clusters.complete_linkage(edges).collect()
    assert {r["cid"] for r in got} == {0} and len(got) == n and len(names) <= 4


def test_pair_join_plan_and_batches(spark, capsys):
    """No norm is computed by lambdas in Spark (once for every component), and
    a group hands on its pairs a tile at a time; zero vectors have none."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(1200, 8)) + 3
    vecs[7] = 0
    idx = rng.permutation(1200).astype("int64")
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["s"] * 1200), pa.array(idx), pa.array(list(vecs)), pa.array([0] * 1200, pa.int32()),
         pa.array([0] * 1200, pa.int32()), pa.array([0] * 1200, pa.int32())], ["k", "index", "vec", "_blk", "_lo", "_hi"])
    out = list(vectors._block_pairs_fn(["k"], 0.3)(iter([batch.slice(0, 500), batch.slice(500)])))
    assert len(out) == 3
    got = {(a, b): d for o in out for a, b, d in zip(*(o.column(c).to_pylist() for c in "abd"), strict=True)}
    with np.errstate(invalid="ignore"):
        u = vecs / np.linalg.norm(vecs, axis=1)[:, None]
    dist = vectors.rounded(1 - u @ u.T)
    i, j = np.nonzero(np.triu(dist < 0.3, k=1))
    want = {(min(idx[x], idx[y]), max(idx[x], idx[y])): dist[x, y] for x, y in zip(i, j, strict=True)}
    assert sum(o.num_rows for o in out) == len(want) and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1.5e-6 for k in want)
    df = spark.createDataFrame([("s", 1, [1.0, 0.0]), ("s", 2, [0.0, 0.0]), ("s", 3, [1.0, 0.1])], "k string, index long, vec array<double>")
    pairs = vectors.similar_pairs(df, keys=["k"])
    assert [(r["a"], r["b"]) for r in pairs.collect()] == [(1, 3)]
    pairs.explain()
    assert "aggregate(vec" not in capsys.readouterr().out.lower().replace("aggregate(transform(vec", "aggregate(vec")


def test_a_large_view_writes_no_graph(spark, monkeypatch):
    """2,500 nodes, more than 2,000: pairs are merged where they are found, or
    where they are sent packed; no table of edges or rounds is written."""
    rng = np.random.default_rng(17)
    vecs = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(2500, 5)).round(2) + 0.01)]
    members = spark.createDataFrame([("d", 1, i) for i, _ in vecs], "digest_date string, part int, index long")
    vecs = spark.createDataFrame(vecs, "index long, vec array<double>")
    names, write = [], clusters._write
    monkeypatch.setattr(clusters, "_write", lambda df, name: (names.append(name), write(df, name))[1])
    monkeypatch.setattr(clusters, "EDGES_AT_ONCE", 1000)      # where tasks run in this process's forks alone
    cols = [*KEYS, "index", "cid", "size", "label"]
    one, far = (sorted(map(tuple, clusters.view_stories(members, vecs, **k).select(*cols).collect()))
                for k in ({}, {"local_max": 0}))
    assert one == far and names == [] and 100 < len({r[3] for r in one}) < 2000


def test_views_with_too_many_pairs_take_rounds(spark):
    """A task gives a view up, in either form, and rounds give the same rows."""
    groups = random_groups(21, 3, 60)
    groups[("2024-01-09", 1)] = {i: np.eye(6)[i % 6] for i in range(3)}
    members = spark.createDataFrame([(*k, i) for k, g in groups.items() for i in g], "digest_date string, part int, index long")
    vecs = spark.createDataFrame([(i, [float(x) for x in v]) for g in groups.values() for i, v in g.items()], "index long, vec array<double>")
    cols = [*KEYS, "index", "cid", "size", "label"]
    got = [sorted(map(tuple, clusters.view_stories(members, vecs, local_max=m, local_edges=k).select(*cols).collect()))
           for m, k in ((1000, 10**6), (1000, 0), (1000, 200), (0, 200), (0, 10**6))]
    assert len(got[0]) == members.count() and all(g == got[0] for g in got)


def test_merge_edges_by_slices(monkeypatch):
    """Few edges at a time, looked at or sorted, and the graph in one piece."""
    rng = np.random.default_rng(2)
    pts = rng.normal(size=(300, 4)).round(1) + 0.03
    u = pts / np.linalg.norm(pts, axis=1)[:, None]
    d = np.round((1 - u @ u.T) * 100).astype("int32")           # many equal distances
    lo, hi = (x.astype("int32") for x in np.nonzero(np.triu(d < 40, k=1)))
    ids = np.arange(300) * 7

    def run():
        edges = [lo.copy(), hi.copy(), d[lo, hi], clusters._counts(len(lo), 300)]
        lab = clusters.merge_edges(ids, edges, np.ones(300, dtype="int64"))
        assert edges == []
        return lab.tolist()

    whole = run()
    monkeypatch.setattr(clusters, "EDGES_AT_ONCE", 97)
    monkeypatch.setattr(clusters, "SORTED_AT_ONCE", 50)
    assert run() == whole and len(lo) > 5000
    one = {frozenset(np.flatnonzero(np.array(whole) == c).tolist()) for c in set(whole)}
    assert all((d[np.ix_(sorted(c), sorted(c))] < 40).all() for c in one) and len(one) < 150


def test_rounds_keep_one_graph(spark, monkeypatch):
    """Tables of finished rounds go: their number does not follow the rounds."""
    import os

    seen, write = [], clusters._write
    monkeypatch.setattr(clusters, "_write", lambda df, name: (seen.append(write(df, name)) if name == "graph" else None, seen[-1] if name == "graph" else write(df, name))[1])
    rows = [("d", 1, i, j, j / 100) for i in range(12) for j in range(i + 1, 12)]
    edges = spark.createDataFrame(rows, "digest_date string, part int, a long, b long, d double")
    made, rm = [], clusters._discard
    monkeypatch.setattr(clusters, "_discard", lambda df: (made.extend(f.removeprefix("file://") for f in df.inputFiles()), rm(df))[1])
    got = clusters.complete_linkage(edges, local_edges=0)
    assert {r["cid"] for r in got.collect()} == {0} and len(seen) > 8
    assert len({os.path.dirname(f) for f in made}) == len(seen) and not any(os.path.exists(f) for f in made)


def test_packed_pairs_are_the_similar_pairs(spark):
    rng = np.random.default_rng(9)
    vecs = rng.normal(size=(200, 4)).round(2) + 0.01
    df = spark.createDataFrame([("s", 5 * i, [float(x) for x in v]) for i, v in enumerate(vecs)], "k string, index long, vec array<double>")
    want = sorted((r["a"], r["b"], round(r["d"] * 1e6)) for r in vectors.similar_pairs(df, keys=["k"]).collect())
    rows = vectors.packed_pairs(df, block_rows=60, keys=["k"]).collect()
    ids = {r["lo"]: np.frombuffer(r["ids"], "int64") for r in rows if r["ids"]}
    got = []
    for r in rows:
        if r["d"]:
            i, j, d = (np.frombuffer(r[c], t) for c, t in (("i", "uint16"), ("j", "uint16"), ("d", "int32")))
            a, b = ids[r["lo"]][i], ids[r["hi"]][j]
            got += zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), d.tolist(), strict=True)
    assert len(ids) == 4 and sorted(got) == want and len(want) > 1000
