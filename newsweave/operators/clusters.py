"""A6 complete-linkage clustering with a distance cut, and W3 story labels.

Complete linkage only merges two clusters when *every* cross pair is below the
threshold, so only edges ``d < threshold`` matter, and slots are independent.
Articles of a view with the same vector (same bag of vector ids) are one node
that weighs as many articles as it stands for.

The state is a cluster-level graph ``(keys, lo, hi, n, dmax, s_lo, s_hi)``:
``n`` cross pairs of nodes below the threshold, their largest distance, and
the nodes of both clusters. A pair is mergeable iff ``n == s_lo * s_hi`` (so
iff all pairs of their articles are, whatever a node weighs); a pair that is
not can never become mergeable again, so its edges are dropped. In each round
every two clusters that are each other's best merge; best is the smallest
``(dmax, md5(lo,hi), lo, hi)``. Without equal distances this is the
one-merge-at-a-time agglomeration, since complete linkage is reducible. Among
equal distances the hash decides, so that many pairs merge in a round instead
of one. Rounds go on until no edge is left; the smallest pair of all is always
merged, so each round makes progress.

``view_stories`` is the entry point. Views are independent, and a graph of
millions of edges fits one task as arrays (``merge_edges``), so a view is done
in one task, in one of two forms: a view of few nodes finds its pairs there
too (``_view_stories_fn``); the pairs of a larger one are found block by block
in many tasks and sent there packed (``linkage``). A task that meets more
edges than it may hold gives its view up. Such views take distributed rounds
(``complete_linkage``): a round is a handful of shuffles over the (shrinking)
graph; its merges and the next graph are written into the shared checkpoint
folder, so lineage stays short, statistics stay real and a lost executor costs
at most one round. The driver only reads two row counts per round, tables of
finished rounds are deleted, and what is left of a view goes to one task as
soon as it is small. All forms give equal rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import broadcast_if_small, checkpoint, shared_path
from .ranking import distributed_row_number

SLOT = ["digest_date", "part"]
# Views of at most this many nodes are clustered inside one task, which holds
# their vectors; 0 = always distributed.
LOCAL_MAX_NODES = 100_000
# A task gives a view up that has more edges than this (some 32 bytes an edge);
# such a view takes distributed rounds.
LOCAL_MAX_EDGES = 16_000_000
# After a distributed round, a view whose graph has at most this many edges
# left does its other rounds in one task; 0 = all rounds are distributed.
LEFT_MAX_EDGES = 4_000_000
# Edges of a graph that are looked at, or sorted, at a time.
EDGES_AT_ONCE = 1 << 20
SORTED_AT_ONCE = 1 << 21
# Pairs of nodes that a task looks at, some seconds of work.
TASK_PAIRS = 1_000_000_000


def _write(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """Write a round's table into the shared folder and read it back with its
    row count (answered from the parquet footers)."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    back = spark.read.parquet(path)
    return back, back.count()


def _discard(df: DataFrame) -> None:
    """Delete a round's table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _mutual_merges(graph: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, old, new, size): pairs that are each other's best (smallest
    ``pair_key``); ``hi`` is merged into ``lo``."""
    pair_key = F.struct("dmax", F.md5(F.concat_ws(",", "lo", "hi")).alias("h"), "lo", "hi")
    cand = (graph.select(*keys, F.col("lo").alias("c"), pair_key.alias("k"))
            .unionByName(graph.select(*keys, F.col("hi").alias("c"), pair_key.alias("k"))))
    best = cand.groupBy(*keys, "c").agg(F.min("k").alias("best"))
    b_lo = best.select(*keys, F.col("c").alias("lo"), F.col("best").alias("b_lo"))
    b_hi = best.select(*keys, F.col("c").alias("hi"), F.col("best").alias("b_hi"))
    return (graph.join(b_lo, [*keys, "lo"]).join(b_hi, [*keys, "hi"])
            .where((F.col("b_lo") == pair_key) & (F.col("b_hi") == pair_key))
            .select(*keys, F.col("hi").alias("old"), F.col("lo").alias("new"),
                    (F.col("s_lo") + F.col("s_hi")).alias("size")))


def _next_graph(graph: DataFrame, merges: DataFrame, keys: list[str]) -> DataFrame:
    """Relabel both ends through the merges, re-aggregate parallel edges and
    keep only complete (still mergeable) cluster pairs."""
    moved = (merges.select(*keys, F.col("old").alias("id"), "new", "size")
             .unionByName(merges.select(*keys, F.col("new").alias("id"), "new", "size")))
    m_lo = moved.select(*keys, F.col("id").alias("lo"), F.col("new").alias("lo_to"), F.col("size").alias("lo_size"))
    m_hi = moved.select(*keys, F.col("id").alias("hi"), F.col("new").alias("hi_to"), F.col("size").alias("hi_size"))
    g = (graph.join(m_lo, [*keys, "lo"], "left").join(m_hi, [*keys, "hi"], "left")
         .select(*keys,
                 F.coalesce("lo_to", "lo").alias("x"), F.coalesce("lo_size", "s_lo").alias("sx"),
                 F.coalesce("hi_to", "hi").alias("y"), F.coalesce("hi_size", "s_hi").alias("sy"),
                 "n", "dmax")
         .where(F.col("x") != F.col("y")))
    lo_first = F.col("x") < F.col("y")
    g = g.select(*keys,
                 F.when(lo_first, F.col("x")).otherwise(F.col("y")).alias("lo"),
                 F.when(lo_first, F.col("y")).otherwise(F.col("x")).alias("hi"),
                 F.when(lo_first, F.col("sx")).otherwise(F.col("sy")).alias("s_lo"),
                 F.when(lo_first, F.col("sy")).otherwise(F.col("sx")).alias("s_hi"),
                 "n", "dmax")
    return (g.groupBy(*keys, "lo", "hi")
            .agg(F.sum("n").alias("n"), F.max("dmax").alias("dmax"),
                 F.first("s_lo").alias("s_lo"), F.first("s_hi").alias("s_hi"))
            .where(F.col("n") == F.col("s_lo") * F.col("s_hi")))


def merge_edges(ids, edges: list, size):
    """All rounds over one view's cluster graph. ``ids`` rise; ``edges``: a list
    of lo, hi (places in ``ids``, lo < hi), d (int32, in the order of the
    distances) and n, which is emptied so that its arrays can go; ``size``:
    nodes of each cluster. Returns the place of the cluster that each ends in.

    The graph is held in 16 to 20 bytes an edge. A round goes over it in
    slices, moves the edges that stay to the front and sorts copies of the
    others, by ranges of their lower cluster, to join the ones that became
    parallel; those are put behind the others."""
    import hashlib

    import numpy as np

    lo, hi, d, n = edges
    edges.clear()
    v = len(ids)
    lab = np.arange(v, dtype="int32")

    def slices(length):
        return [slice(at, at + EDGES_AT_ONCE) for at in range(0, length, EDGES_AT_ONCE)]

    def tie_order(at):
        """Two numbers for each edge, in the order of the md5 of its ids."""
        raw = b"".join(hashlib.md5(f"{ids[a]},{ids[b]}".encode()).digest() for a, b in zip(lo[at], hi[at]))
        return np.frombuffer(raw, ">u8").reshape(-1, 2).astype("uint64").T

    while len(lo):
        low = np.full(v, np.iinfo("int32").max, dtype="int32")
        for part in slices(len(lo)):
            np.minimum.at(low, lo[part], d[part])
            np.minimum.at(low, hi[part], d[part])
        found = []
        for part in slices(len(lo)):
            for end in (lo[part], hi[part]):
                e = np.flatnonzero(d[part] == low[end])
                found.append((end[e], e + part.start))
        node, edge = (np.concatenate(x) for x in zip(*found, strict=True))
        best = np.full(v, -1)
        best[node] = edge
        tied = np.bincount(node, minlength=v)[node] > 1
        if tied.any():
            node, edge = node[tied], edge[tied]
            own, back = np.unique(edge, return_inverse=True)
            first, second = tie_order(own)
            order = np.lexsort((hi[edge], lo[edge], second[back], first[back], node))
            top, begin = np.unique(node[order], return_index=True)
            best[top] = edge[order[begin]]
        some = np.unique(best[best >= 0])
        mutual = some[(best[lo[some]] == some) & (best[hi[some]] == some)]
        keep, gone = lo[mutual], hi[mutual]
        size[keep] += size[gone]
        to = np.arange(v, dtype="int32")
        to[gone] = keep
        lab = to[lab]
        moved = np.zeros(v, dtype=bool)
        moved[keep] = True
        stay, change, per_node = 0, [], np.zeros(v, dtype="int64")
        for part in slices(len(lo)):
            x, y, dist, count = to[lo[part]], to[hi[part]], d[part], n[part]
            again = moved[x] | moved[y]                  # all others stay as they are
            c = np.flatnonzero(again & (x != y))
            a = np.minimum(x[c], y[c])
            per_node += np.bincount(a, minlength=v)
            change.append((a, np.maximum(x[c], y[c]), dist[c], count[c]))
            kept = np.flatnonzero(~again)
            here = slice(stay, stay + len(kept))
            lo[here], hi[here], d[here], n[here] = x[kept], y[kept], dist[kept], count[kept]
            stay = here.stop
        # joined only where two ends moved to one: the numbers of clusters with at most SORTED_AT_ONCE such edges
        range_of = np.cumsum(per_node) // SORTED_AT_ONCE
        for r in np.unique(range_of[per_node > 0]):
            mine = [[col[w] for col in c] for c in change for w in [np.flatnonzero(range_of[c[0]] == r)]]
            a, b, dist, count = (np.concatenate(x) for x in zip(*mine, strict=True))
            key = a.astype("int64") * v + b
            order = np.argsort(key)
            begin = np.flatnonzero(np.diff(key[order], prepend=-1))
            total = np.add.reduceat(count[order], begin, dtype="int64")
            most = np.maximum.reduceat(dist[order], begin)
            a, b = a[order[begin]], b[order[begin]]
            whole = np.flatnonzero(total == size[a] * size[b])
            here = slice(stay, stay + len(whole))            # never beyond the edges read: joined ones are fewer
            lo[here], hi[here], d[here], n[here] = a[whole], b[whole], most[whole], total[whole]
            stay = here.stop
        del change
        lo, hi, d, n = lo[:stay], hi[:stay], d[:stay], n[:stay]
        if lo.base is not None and stay < len(lo.base) // 2:
            lo, hi, d, n = lo.copy(), hi.copy(), d.copy(), n.copy()
    return lab


def _counts(n_edges: int, n_nodes: int):
    """Pairs of nodes behind each edge at the start, in a type that holds those
    of any two clusters."""
    import numpy as np

    return np.ones(n_edges, dtype="uint32" if n_nodes < 1 << 17 else "int64")


def _finish(graph: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, old, new): the clusters that each view's clusters end in, one
    task for a view."""
    import numpy as np

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, at = np.unique(np.concatenate([pdf["lo"], pdf["hi"]]), return_inverse=True)
        lo, hi = at[:len(pdf)].astype("int32"), at[len(pdf):].astype("int32")
        size = np.zeros(len(ids), dtype="int64")
        size[lo], size[hi] = pdf["s_lo"], pdf["s_hi"]
        d = np.unique(pdf["dmax"], return_inverse=True)[1].astype("int32")
        new = ids[merge_edges(ids, [lo, hi, d, pdf["n"].to_numpy(dtype="int64", copy=True)], size)]
        out = pd.DataFrame({k: pdf[k].iloc[0] for k in keys}, index=range(len(ids)))
        out["old"], out["new"] = ids, new
        return out[out["old"] != out["new"]]

    schema = T.StructType([*[graph.schema[k] for k in keys], T.StructField("old", T.LongType()), T.StructField("new", T.LongType())])
    return graph.groupBy(*keys).applyInPandas(run, schema)


def _merge_packed_fn(keys: list[str], local_edges: int):
    """One view's packed pairs in one task: (keys, index, cid) for its nodes, or
    one row without them if it has more than ``local_edges``."""
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, packed, total, first = {}, [], 0, None
        for batch in batches:
            first = first or [batch.column(k).slice(0, 1) for k in keys]
            if total > local_edges:
                continue
            for lo, hi, raw, i, j, d in zip(*(batch.column(c) for c in ("lo", "hi", "ids", "i", "j", "d")), strict=True):
                if raw.is_valid:
                    blocks[lo.as_py()] = np.frombuffer(raw.as_buffer(), "int64")
                else:
                    i, j, d = (np.frombuffer(x.as_buffer(), t).copy() for x, t in ((i, "uint16"), (j, "uint16"), (d, "int32")))
                    packed.append((lo.as_py(), hi.as_py(), i, j, d))
                    total += len(d)
        if total > local_edges:
            index = cid = pa.array([None], pa.int64())
        else:
            ids = np.concatenate([*blocks.values(), np.zeros(0, "int64")])
            order = np.argsort(ids)
            rank = np.empty(len(ids), dtype="int32")
            rank[order] = np.arange(len(ids))
            ids, at, place = ids[order], 0, {}
            for b, x in blocks.items():
                place[b] = rank[at:at + len(x)]
                at += len(x)
            lo, hi, dist = (np.empty(total, dtype="int32") for _ in range(3))
            while packed:
                a, b, i, j, d = packed.pop()
                x, y, mine = place[a][i], place[b][j], slice(total - len(d), total)
                lo[mine], hi[mine], dist[mine] = np.minimum(x, y), np.maximum(x, y), d
                total -= len(d)
            edges = [lo, hi, dist, _counts(len(lo), len(ids))]
            del lo, hi, dist
            lab = merge_edges(ids, edges, np.ones(len(ids), dtype="int64"))
            index, cid = pa.array(ids), pa.array(ids[lab])
        same = pa.array(np.zeros(len(index), "int32"))
        yield pa.RecordBatch.from_arrays([*[k.take(same) for k in first], index, cid], [*keys, "index", "cid"])

    return run


def linkage(vectors: DataFrame, threshold: float = 0.3, keys: list[str] | None = None,
            local_edges: int | None = None) -> DataFrame:
    """(keys..., index, cid) of ``vectors`` (keys..., index, vec): the pairs of
    a view are found block by block in many tasks and go to one task in eight
    bytes each, without a table of them. Views of more than ``local_edges``
    take the distributed rounds of ``complete_linkage``."""
    from .vectors import packed_pairs, similar_pairs

    keys = keys if keys is not None else SLOT
    local_edges = LOCAL_MAX_EDGES if local_edges is None else local_edges
    schema = T.StructType([*[vectors.schema[k] for k in keys], T.StructField("index", T.LongType()), T.StructField("cid", T.LongType())])
    found = checkpoint(packed_pairs(vectors, threshold, keys=keys).groupBy(*keys)
                       .applyInArrow(_merge_packed_fn(keys, local_edges), schema), "merged")
    more = checkpoint(found.where(F.col("index").isNull()).select(*keys), "many-edges")
    if more.isEmpty():
        return found
    edges = similar_pairs(vectors.join(broadcast_if_small(more), keys, "left_semi"), threshold, keys=keys)
    return found.where(F.col("index").isNotNull()).unionByName(complete_linkage(edges, keys))


def complete_linkage(edges: DataFrame, keys: list[str] | None = None, fold_every: int = 8,
                     local_edges: int | None = None) -> DataFrame:
    """(keys..., index, cid) for every node that has at least one edge; ``cid``
    is the smallest index of its cluster. Nodes without edges are singletons
    and do not appear. ``edges``: (keys..., a, b, d).

    Graph rows carry the nodes of both clusters, so a round needs no join
    with the assignment: it writes the merges and the next graph (two jobs).
    Views of at most ``local_edges`` edges leave the graph and are finished in
    one task each. The assignment is folded from the recorded merges every
    ``fold_every`` rounds and at the end."""
    keys = keys if keys is not None else SLOT
    local_edges = LEFT_MAX_EDGES if local_edges is None else local_edges
    one = F.lit(1).cast("long")
    graph, n_edges = _write(
        edges.select(*keys, F.col("a").alias("lo"), F.col("b").alias("hi"), one.alias("n"), F.col("d").alias("dmax"),
                     one.alias("s_lo"), one.alias("s_hi")), "graph")
    nodes = (graph.select(*keys, F.col("lo").alias("index"))
             .unionByName(graph.select(*keys, F.col("hi").alias("index"))).distinct())
    assign, _ = _write(nodes.withColumn("cid", F.col("index")), "assign")
    pending: list[DataFrame] = []

    def fold(assign: DataFrame, pending: list[DataFrame]) -> DataFrame:
        for m in pending:
            assign = (assign.join(m.select(*keys, F.col("old").alias("cid"), "new"), [*keys, "cid"], "left")
                      .select(*keys, "index", F.coalesce("new", "cid").alias("cid")))
        return _write(assign, "assign")[0]

    def following(graph: DataFrame, df: DataFrame) -> tuple[DataFrame, int]:
        """``df``, made from ``graph``, takes its place."""
        new = _write(df, "graph")
        _discard(graph)
        return new

    while n_edges > 0:
        if local_edges:
            counts = checkpoint(graph.groupBy(*keys).agg(F.count("*").alias("_n")), "edge-counts")
            small = broadcast_if_small(counts.where(F.col("_n") <= local_edges).select(*keys))
            n_large = counts.where(F.col("_n") > local_edges).agg(F.sum("_n").alias("n")).first()["n"] or 0
            if n_large < n_edges:
                pending.append(_write(_finish(graph.join(small, keys, "left_semi"), keys), "finished")[0])
                if n_large == 0:
                    break
                graph, n_edges = following(graph, graph.join(small, keys, "left_anti"))
        merges, n_merges = _write(_mutual_merges(graph, keys), "merges")
        if n_merges == 0:
            raise RuntimeError("a merge round made no progress")
        pending.append(merges)
        graph, n_edges = following(graph, _next_graph(graph, merges, keys))
        if len(pending) >= fold_every:
            assign, pending = fold(assign, pending), []
    _discard(graph)
    return fold(assign, pending) if pending else assign


def cluster_nodes(nodes: DataFrame, edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``nodes`` (keys..., index, copies) with ``cid`` by ``edges`` (keys...,
    a, b, d) and the cluster ``size`` in articles."""
    return _with_sizes(nodes, complete_linkage(edges, keys), keys if keys is not None else SLOT)


def _with_sizes(nodes: DataFrame, assign: DataFrame, keys: list[str]) -> DataFrame:
    """Singletons keep their own index."""
    out = (nodes.select(*keys, "index", "copies").join(assign, [*keys, "index"], "left")
           .withColumn("cid", F.coalesce("cid", "index")))
    sizes = out.groupBy(*keys, "cid").agg(F.sum("copies").alias("size"))
    return out.join(sizes, [*keys, "cid"])


def story_labels(clustered: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per slot, label 1.. by size desc then smallest member index
    (distributed numbering: a huge slot is not one window partition)."""
    keys = keys if keys is not None else SLOT
    clusters = clustered.select(*keys, "cid", "size").distinct()
    labels = distributed_row_number(clusters, keys, [F.desc("size"), F.asc("cid")], "label")
    return clustered.join(labels.select(*keys, "cid", "label"), [*keys, "cid"])


def _view_stories_fn(keys: list[str], threshold: float, local_edges: int):
    """One view in one task: the pairs of all its nodes, complete linkage, sizes
    and the W3 labels. Nodes without a vector stay singletons. A view of more
    than ``local_edges`` pairs gives one row without a node."""
    import numpy as np

    from .vectors import near_pairs, unit_rows

    def merged(idx, u):
        """The place of the cluster of each node, none for too many pairs."""
        parts, total = [], 0
        for i, j, d in near_pairs(u, u, threshold, True):
            parts.append((i.astype("int32"), j.astype("int32"), np.rint(d * 1e6).astype("int32")))
            total += len(d)
            if total > local_edges:
                return None
        edges = []
        for k in range(3):
            edges.append(np.concatenate([p[k] for p in parts]))
            parts = [(*p[:k], None, *p[k + 1:]) for p in parts]
        edges.append(_counts(total, len(idx)))
        return merge_edges(idx, edges, np.ones(len(idx), dtype="int64"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by("index")
        first = [table[k].slice(0, 1).combine_chunks() for k in keys]
        idx, copies, vecs = table["index"].to_numpy(), table["copies"].to_numpy(), table["vec"].combine_chunks()
        del table
        cid = idx.copy()
        pos = np.flatnonzero(vecs.is_valid().to_numpy(zero_copy_only=False))
        if len(pos):
            ok, u = unit_rows(vecs.drop_null().flatten().to_numpy().reshape(len(pos), -1))
            pos = pos[ok]
            if len(pos):
                lab = merged(idx[pos], u)
                cid = None if lab is None else cid
                if lab is not None:
                    cid[pos] = idx[pos][lab]
        if cid is None:
            columns = [pa.array([None], pa.int64())] * 4
        else:
            uniq, inverse = np.unique(cid, return_inverse=True)
            sizes = np.bincount(inverse, copies).astype("int64")
            order = np.lexsort((uniq, -sizes))          # size desc, then smallest id
            label = np.empty(len(uniq), dtype="int64")
            label[order] = np.arange(1, len(uniq) + 1)
            columns = [pa.array(x) for x in (idx, cid, sizes[inverse], label[inverse])]
        same = pa.array(np.zeros(len(columns[0]), "int32"))
        yield pa.RecordBatch.from_arrays([*[k.take(same) for k in first], *columns], [*keys, "index", "cid", "size", "label"])

    return run


def view_nodes(members: DataFrame, vecs: DataFrame, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Members (keys..., index, node) and nodes (keys..., index, copies, vec).
    Articles of a view with the same non-zero vector share a node, named by
    the smallest index; an article without a vector is its own node."""
    keys = keys if keys is not None else SLOT
    if "bag" not in vecs.columns:
        vecs = vecs.withColumn("bag", F.array("index"))
    zero = F.forall("vec", lambda x: x == 0)
    bag = F.when(~zero, F.col("bag"))
    m = members.select(*keys, "index").join(vecs.select("index", bag.alias("bag")), "index", "left")
    # a node's key: its bag, or the article itself
    m = m.withColumn("own", F.when(F.col("bag").isNull(), F.col("index")))
    named = m.groupBy(*keys, "bag", "own").agg(F.min("index").alias("node"), F.count("*").alias("copies"))
    group = [F.col(f"m.{k}").eqNullSafe(F.col(f"g.{k}")) for k in [*keys, "bag", "own"]]
    linked = checkpoint(m.alias("m").join(named.alias("g"), group)
                        .select(*[F.col(f"m.{k}").alias(k) for k in keys], "m.index", "g.node", "g.copies"), "members")
    nodes = (linked.where(F.col("index") == F.col("node")).select(*keys, "index", "copies")
             .join(vecs.select("index", "vec"), "index", "left"))
    return linked.drop("copies"), nodes.select(*keys, "index", "copies", "vec")


def view_stories(members: DataFrame, vecs: DataFrame, keys: list[str] | None = None, threshold: float = 0.3,
                 local_max: int = LOCAL_MAX_NODES, local_edges: int | None = None) -> DataFrame:
    """(keys..., index, cid, size, label) for every member of every view.

    Views of at most ``local_max`` nodes (counted per view; one row per view)
    are done in one task each: pairs, complete linkage, sizes and labels
    together, unless they have more than ``local_edges`` pairs. All others use
    the distributed path: blocked pair join, merge rounds, distributed
    numbering. Both give the same result."""
    keys = keys if keys is not None else SLOT
    local_edges = LOCAL_MAX_EDGES if local_edges is None else local_edges
    linked, nodes = view_nodes(members, vecs, keys)
    nodes = checkpoint(nodes, "nodes")
    counts = checkpoint(nodes.groupBy(*keys).agg(F.count("*").alias("_n")), "node-counts")
    few = counts.where(F.col("_n") <= local_max)
    n_few, pairs, n_views = few.agg(F.count("*"), F.sum(F.col("_n").cast("double") * F.col("_n"))).first()[:] + (counts.count(),)
    schema = T.StructType([*[members.schema[k] for k in keys],
                           T.StructField("index", T.LongType()), T.StructField("cid", T.LongType()),
                           T.StructField("size", T.LongType()), T.StructField("label", T.LongType())])
    rest, stories = counts.where(F.col("_n") > local_max).select(*keys), None
    if n_few:
        # as many tasks as the pairs need: their rows say little about their work
        tasks = min(n_few, max(members.sparkSession.sparkContext.defaultParallelism, math.ceil(pairs / TASK_PAIRS)))
        small = nodes.join(broadcast_if_small(few.select(*keys)), keys, "left_semi").repartition(tasks, *keys)
        stories = checkpoint(small.groupBy(*keys).applyInArrow(_view_stories_fn(keys, threshold, local_edges), schema), "view-stories")
        rest = checkpoint(rest.unionByName(stories.where(F.col("index").isNull()).select(*keys)), "large-views")
        stories = stories.where(F.col("index").isNotNull())
    if n_few < n_views or not rest.isEmpty():
        large = checkpoint(nodes.join(broadcast_if_small(rest), keys, "left_semi"), "large") if n_few else nodes
        found = linkage(large.where(F.col("vec").isNotNull()), threshold, keys, local_edges)
        big = story_labels(_with_sizes(large, found, keys), keys).select(*keys, "index", "cid", "size", "label")
        stories = big if stories is None else stories.unionByName(big)
    if stories is None:
        stories = members.sparkSession.createDataFrame([], schema)
    return linked.join(stories.withColumnRenamed("index", "node"), [*keys, "node"]).drop("node")
