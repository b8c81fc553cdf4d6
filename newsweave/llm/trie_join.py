"""N-gram Jaccard join by prefix trees.

A document's set is its distinct word shingles as 64-bit keys in one global
order: shingles of frequent hash buckets last, before them by how frequent
their words are, then by hash (counts of hashed shingles and words over the
whole corpus are two tables of fixed size). So the first keys of a set are
those that few other documents hold. Equal sets are one class; exact copies
cost nothing further.

Candidates: two sets of Jaccard t or more share at least 1 + e of their first
``n - ceil(t * n) + 1 + e`` keys (their prefix; e is ``EXTRA`` per cent of the
smaller set). Keys of a single class drop out first. A key that more than
``COLD`` classes share is hot, as those of a passage that many documents quote
or of a large group of near copies. A class with at most e hot keys leaves
them aside: every class that it links with shares a cold one too.

* Cold keys: classes meet on them two by two, at most ``COLD`` of a key. A
  pair goes on where its sizes allow a link and its shared keys, counted, leave
  one possible. The sets that meet one class are stored in a prefix tree, first
  their prefixes, then the whole sets of what is left, and the class's set walks the tree.
* Hot keys: classes that share hot keys form clusters. A cluster's classes, in
  order of size, are dealt into blocks; two blocks whose sizes allow a link
  meet at a time, and all sets of one walk the other's prefix tree together. A
  block hands on the number of links of each class and the components within
  it, never the links: a group of near copies costs rows in proportion to its
  size and blocks.

The tree walk: a path-compressed prefix tree holds sets in the global order.
Sets with a common beginning share the overlap counted so far, and a subtree is
left as soon as that overlap plus what its longest set or the probe's rest
could add misses the bound for its shortest set. Over prefixes, a set's
remaining length counts as if all of it could match.

Linked classes are joined into components. Every link is verified, in one
component or not; a row has the number of its class's links.

Nulls: null or empty text, or one without words, has an empty set, links with
nothing and is a component of its own. A null id sorts behind all others;
a component of null ids has a null id. Repeated ids: each row is a document of
its own. Repeated rows are copies. Fewer than
``n`` words are one shingle. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import distributed_row_number
from ..session import broadcast_if_small
from .common import batches_of, release_worker_cache, sum_pieces, to_pieces, written
from .components import components
from .words import Words, shingles

SHINGLE = 4
PERCENT = 85
#: Additional keys of a prefix, in per cent of the set.
EXTRA = 5
#: Most classes of a cold key.
COLD = 16
#: log2 of the hash buckets whose counts order the shingles.
ORDER_BITS = 18
#: Most sets, and keys of a block; a larger set is a block of its own.
BLOCK, BLOCK_KEYS = 512, 1 << 17
#: Broadcast bound of tables that grow with the corpus.
_SMALL = 8 << 20
#: Texts handled at once, in bytes.
_CHUNK = 1 << 20
_LEVEL, _RARITY, _HASH = np.uint64(59), np.uint64(52), np.uint64(12)


def needed(a, b, percent: int = PERCENT):
    """Least overlap of sets of a and b keys that links them."""
    return -(-(a + b) * percent // (100 + percent))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return min(n, n - (-(-n * percent // 100)) + 1 + n * EXTRA // 100)


def prefix_sql(n: str, percent: int = PERCENT) -> str:
    return f"least({n}, {n} - ceil({n} * {percent} / 100) + 1 + {n} * {EXTRA} div 100)"


def spare_keys(n: str, percent: int = PERCENT) -> str:
    """SQL: a set of n keys shares more prefix keys than this with any set that
    it links with (the smallest has ``percent`` of its keys)."""
    return f"ceil({n} * {percent} / 100) * {EXTRA} div 100"


def linked(overlap: int, a: int, b: int, percent: int = PERCENT) -> bool:
    return 100 * overlap >= percent * (a + b - overlap)


# ------------------------------------------------------------- prefix tree

def tree_join(probe: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT, n: int | None = None,
              sizes: list[int] | None = None) -> list[int]:
    """Which of ``sets`` (each ascending) link with ``probe``. If ``n`` and
    ``sizes`` say that the arrays are only the beginnings of larger sets:
    which can link, whatever follows."""
    n = len(probe) if n is None else n
    order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
    rows = [sets[i] for i in order]
    size = np.array([len(r) for r in rows])
    full = size if sizes is None else np.array([sizes[i] for i in order])
    # Common beginning of each set with the one before it: with the sorted
    # order this is the tree; a node is a run of sets.
    common = np.zeros(len(rows), np.int64)
    for i in range(1, len(rows)):
        m = min(size[i - 1], size[i])
        diff = np.flatnonzero(rows[i - 1][:m] != rows[i][:m])
        common[i] = diff[0] if len(diff) else m
    found, stack = [], [(0, len(rows), 0, 0)]
    while stack:
        lo, hi, depth, overlap = stack.pop()
        end = int(size[lo]) if hi - lo == 1 else int(common[lo + 1:hi].min())
        if end > depth:
            edge = rows[lo][depth:end]
            at = np.searchsorted(probe, edge)
            inside = at < len(probe)
            overlap += int(np.count_nonzero(probe[at[inside]] == edge[inside]))
        passed = int(np.searchsorted(probe, rows[lo][end - 1], "right")) if end else 0
        if hi - lo == 1:
            # keys of the set above the probe's last one have no partner yet
            seen = int(np.searchsorted(rows[lo], probe[-1], "right"))
            if overlap + min(n - passed, int(full[lo]) - seen) >= needed(n, int(full[lo]), percent):
                found.append(order[lo])
            continue
        longest, shortest = int(full[lo:hi].max()), int(full[lo:hi].min())
        if overlap + min(n - passed, longest - min(end, int(np.searchsorted(rows[lo][:end], probe[-1], "right")))) \
                < needed(n, shortest, percent):
            continue
        cuts = [lo, *(lo + 1 + np.flatnonzero(common[lo + 1:hi] == end)).tolist(), hi]
        stack += [(a, b, end, overlap) for a, b in zip(cuts, cuts[1:], strict=False)]
    return found


def _tree(sets: list[np.ndarray]) -> tuple[list[int], np.ndarray]:
    """The sets' order in the tree, and how long a beginning each shares with
    the one before it."""
    order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
    common = np.zeros(len(order), np.int64)
    for k in range(1, len(order)):
        x, y = sets[order[k - 1]], sets[order[k]]
        m = min(len(x), len(y))
        diff = np.flatnonzero(x[:m] != y[:m])
        common[k] = diff[0] if len(diff) else m
    return order, common


def block_join(probes: list[np.ndarray], sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """Which of ``probes`` (rows) link with which of ``sets`` (columns); all
    probes walk the tree of the sets together."""
    out = np.zeros((len(probes), len(sets)), bool)
    order, common = _tree(sets)
    n = np.array([len(p) for p in probes])
    size = np.array([len(sets[i]) for i in order])
    keys, where = np.unique(np.concatenate(probes), return_inverse=True)
    held = np.zeros((len(keys) + 1, len(probes)), np.uint8)  # the last row is for keys of no probe
    held[where, np.repeat(np.arange(len(probes)), n)] = 1
    at = [np.searchsorted(keys, sets[i]) for i in order]
    at = [np.where(keys[np.minimum(x, len(keys) - 1)] == sets[i], x, len(keys)) for x, i in zip(at, order, strict=True)]
    stack = [(0, len(order), 0, np.zeros(len(probes), np.int64))]
    while stack:
        lo, hi, depth, overlap = stack.pop()
        end = int(size[lo]) if hi - lo == 1 else int(common[lo + 1:hi].min())
        if end > depth:
            overlap = overlap + held[at[lo][depth:end]].sum(0, dtype=np.int64)
        longest, shortest = int(size[lo:hi].max()), int(size[lo:hi].min())
        could = overlap + np.minimum(n - overlap, longest - end) >= needed(n, shortest, percent)
        if hi - lo == 1:
            out[:, order[lo]] = could
        elif could.any():
            cuts = [lo, *(lo + 1 + np.flatnonzero(common[lo + 1:hi] == end)).tolist(), hi]
            stack += [(a, b, end, overlap) for a, b in zip(cuts, cuts[1:], strict=False)]
    return out


# ------------------------------------------------------------- sets

def bucket_counts(docs: DataFrame, n: int = SHINGLE) -> list[np.ndarray]:
    """How many shingles and how many words of the corpus fall in each hash
    bucket: partial counts of each task, summed in pieces."""
    size = 1 << ORDER_BITS

    def run(batches: Iterator) -> Iterator:
        release_worker_cache()
        total = np.zeros((2, size))
        for batch in batches_of(batches, _CHUNK):
            w = Words(batch.column(0))
            for k, h in enumerate((shingles(w, n)[0], w.hashes)):
                total[k] += np.bincount(_bucket(h), minlength=size)
        if total.any():
            yield to_pieces(total[0], "<f4")
            yield to_pieces(total[1], "<f4", 1 << 16)

    return sum_pieces(docs.select("text").mapInArrow(run, "piece int, data binary"), [(size, "<f4")] * 2)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - ORDER_BITS)).astype(np.int64)


class Order:
    """The global order: a shingle's level is 0 up to twice the mean count of a
    bucket and one more at each doubling (31 at most); a word weighs 2 for
    each doubling of its bucket's count above the mean."""

    def __init__(self, counts: list[np.ndarray]):
        above = lambda c: np.log2(np.maximum(c, 1) / max(1.0, c.mean()))
        self.level = np.clip(np.floor(above(counts[0])), 0, 31).astype(np.uint64)
        self.weight = np.clip(np.floor(2 * above(counts[1])), 0, 40).astype(np.int64)

    def sets(self, column, n: int) -> list[np.ndarray]:
        """Each text's distinct keys, ascending."""
        w = Words(column)
        s, upto, common = shingles(w, n, self.weight[_bucket(w.hashes)])
        keys = (self.level[_bucket(s)] << _LEVEL) | (np.minimum(common, 127).astype(np.uint64) << _RARITY) | (s >> _HASH)
        return [np.unique(keys[a:b]) for a, b in zip(upto[:-1], upto[1:], strict=True)]


def signature(keys: np.ndarray) -> bytes:
    return hashlib.blake2b(keys.tobytes(), digest_size=16).digest()


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


# ------------------------------------------------------------- join

def similar(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id",
            text_col: str = "text", cold: int = COLD) -> DataFrame:
    """doc_id, n_shingles, class_id (least id of equal sets), component_id
    (least id of the component) and n_links (other classes that the row's class
    links with) of every row."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = Order(bucket_counts(docs, n))

    def sets(batches: Iterator) -> Iterator:
        import pyarrow as pa

        release_worker_cache()
        for batch in batches_of(batches, _CHUNK):
            rows = order.sets(batch.column(1), n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([len(k) for k in rows], pa.int64()),
                 pa.array([signature(k) if len(k) else None for k in rows], pa.binary()),
                 pa.array([k[:prefix_length(len(k), percent)].tobytes() if len(k) else None for k in rows],
                          pa.binary())], ["doc_id", "hash", "n", "sig", "prefix"])

    each = written(docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
                   .mapInArrow(sets, "doc_id long, hash long, n long, sig binary, prefix binary")
                   .withColumn("row", F.monotonically_increasing_id()), "sets")
    classes = written(each.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("class_id"),
                                                             F.min("row").alias("node")), "classes", "snappy")
    first = each.join(broadcast_if_small(classes.select(F.col("node").alias("row")), _SMALL), "row", "left_semi")
    beginnings = first.select(F.col("row").alias("node"), "n", F.col("prefix").alias("keys"))
    sources = first.select(F.col("row").alias("node"), "sig", F.col("doc_id").alias("of_id"), F.col("hash").alias("of_hash"))

    def keys(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches_of(batches, _CHUNK):
            got = [np.frombuffer(x, "<u8") for x in batch.column(2).to_pylist()]
            sizes = [len(x) for x in got]
            yield pa.RecordBatch.from_arrays(
                [pa.array(_signed(np.concatenate(got)))]
                + [pa.array(np.repeat(batch.column(k).to_numpy(), sizes)) for k in (0, 1)], ["key", "node", "n"])

    every = beginnings.select("node", "n", "keys").mapInArrow(keys, "key long, node long, n long")
    shared = written(every.groupBy("key").agg(F.count("*").alias("of")).where("of > 1"), "shared", "snappy")
    met = written(every.join(broadcast_if_small(shared, _SMALL), "key"), "keys", "snappy")
    # Classes with few hot keys leave those aside.
    hot = met.where(F.col("of") > cold)
    facts = written(hot.groupBy("node", "n").agg(F.count("*").alias("hot")).withColumn(
        "aside", F.expr(f"hot <= {spare_keys('n', percent)}")), "hot-counts", "snappy")
    clusters = written(_clusters(hot.join(broadcast_if_small(facts.where("not aside").select("node"), _SMALL), "node",
                                          "left_semi").select("key", "node")), "clusters", "snappy")

    # Cold keys: pairs whose sizes, and then shared keys, leave a link possible.
    colds = met.where(F.col("of") <= cold).select("key", "node", "n") \
        .join(broadcast_if_small(clusters, _SMALL), "node", "left")
    x, y = (colds.select("key", *[F.col(c).alias(f"{c}_{e}") for c in ("node", "n", "cluster")]) for e in ("a", "b"))
    pairs = x.join(y, "key").where("node_a < node_b").where(
        F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
        & ~F.coalesce(F.col("cluster_a") == F.col("cluster_b"), F.lit(False))) \
        .groupBy(F.col("node_a").alias("a"), F.col("node_b").alias("b"), "n_a", "n_b").agg(F.count("*").alias("c"))
    # Shared keys that were not counted are hot: at most the fewer hot ones of both. Less than the bound with all
    # that is behind the prefix that ends first is no link.
    for e in ("a", "b"):
        pairs = pairs.join(broadcast_if_small(facts.select(F.col("node").alias(e), F.col("hot").alias(f"hot_{e}")), _SMALL),
                           e, "left")
    behind = F.greatest(*[F.expr(f"n_{e} - {prefix_sql(f'n_{e}', percent)}") for e in ("a", "b")])
    more = F.least(*[F.coalesce(F.col(f"hot_{e}"), F.lit(0)) for e in ("a", "b")])
    pairs = written(pairs.where((F.col("c") + more + behind) * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent)
                    .select("a", "b"), "pairs", "snappy")
    maybe = written(_walk(beginnings, pairs, percent).where("linked"), "maybe", "snappy")
    nodes = maybe.select(F.col("a").alias("node")).unionByName(maybe.select(F.col("b").alias("node"))) \
        .unionByName(clusters.select("node")).distinct()
    full = written(_full_sets(docs, sources, nodes, order, n), "whole-sets")
    links = written(_walk(full, maybe, percent).where("linked").select("a", "b"), "verified", "snappy")
    inside = written(_in_clusters(full, clusters, percent), "in-clusters", "snappy")

    roots = written(components(links.unionByName(inside.where("node <> least").select(
        F.col("node").alias("a"), F.col("least").alias("b")))), "roots", "snappy")
    counts = links.select(F.explode(F.array("a", "b")).alias("node"), F.lit(1).cast("long").alias("links")) \
        .unionByName(inside.select("node", "links")).groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.join(broadcast_if_small(roots, _SMALL), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("class_id").alias("component_id"))
    named = named.join(least, "root").join(broadcast_if_small(counts, _SMALL), "node", "left")
    named = written(named.select("sig", "class_id", "component_id", "links"), "named", "snappy")
    own = lambda c: F.when(F.col("n") > 0, F.col(c)).otherwise(F.col("doc_id")).alias(c)
    return each.select("doc_id", "n", "sig").join(named, "sig", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), own("class_id"), own("component_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def _clusters(rows: DataFrame) -> DataFrame:
    """node, cluster of all classes that share hot keys with others, from
    (key, node)."""
    rows = written(rows, "hot-keys", "snappy")
    least = rows.groupBy("key").agg(F.min("node").alias("least"))
    links = written(rows.join(least, "key").where("node > least").select("node", "least").distinct(), "hot-links", "snappy")
    return components(links, "node", "least").withColumnRenamed("root", "cluster")


def _in_clusters(full: DataFrame, clusters: DataFrame, percent: int) -> DataFrame:
    """node, links, least: how many classes of the other or the same block a
    class links with, and the least class of its component there, for each
    meeting of two blocks in which it has a link."""
    sized = clusters.join(full.select("node", "n"), "node")
    ranked = distributed_row_number(sized, ["cluster"], [F.col("n"), F.col("node")], "rank")
    # By size, so blocks of small sets hold as many as the largest of them allows.
    room = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(BLOCK_KEYS / F.pow(2, F.ceil(F.log2("n"))))))
    dealt = written(ranked.select("cluster", "node", "n", "rank", room.cast("long").alias("room"))
                    .withColumn("block", F.struct("room", F.expr("rank div room").alias("at"))), "dealt", "snappy")
    blocks = dealt.groupBy("cluster", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    u, v = (blocks.select("cluster", *[F.col(c).alias(f"{c}{e}") for c in ("block", "lo", "hi")]) for e in (1, 2))
    met = written(u.join(v, "cluster").where(
        (F.struct("lo1", "hi1", "block1") <= F.struct("lo2", "hi2", "block2"))
        & (100 * F.col("hi1") >= percent * F.col("lo2")))
        .select("cluster", "block1", "block2", F.monotonically_increasing_id().alias("meeting")), "meetings", "snappy")
    same = F.col("block1") == F.col("block2")
    sides = met.select("cluster", F.col("block1").alias("block"), "meeting", F.when(same, 2).otherwise(0).alias("side")) \
        .unionByName(met.where(~same).select("cluster", F.col("block2").alias("block"), "meeting", F.lit(1).alias("side")))
    roles = dealt.join(sides, ["cluster", "block"]).select("node", "meeting", "side")

    def join(batches: Iterator) -> Iterator:
        import pyarrow as pa

        release_worker_cache()
        meeting, held = None, []

        def one() -> pa.RecordBatch:
            left = [h for h in held if h[0] != 1]
            right = left if left and left[0][0] == 2 else [h for h in held if h[0] == 1]
            a, b = (np.array([h[1] for h in x], np.int64) for x in (left, right))
            found = block_join([h[2] for h in left], [h[2] for h in right], percent) if left and right \
                else np.zeros((len(left), len(right)), bool)
            if right is left:
                np.fill_diagonal(found, False)
            label_a, label_b = a.copy(), b.copy()
            big = np.iinfo(np.int64).max
            while found.any():  # least class of each component, passed along the links
                new_b = np.minimum(label_b, np.where(found, label_a[:, None], big).min(0))
                new_a = np.minimum(label_a, np.where(found, new_b[None, :], big).min(1))
                if (new_a == label_a).all() and (new_b == label_b).all():
                    break
                label_a, label_b = new_a, new_b
            node, links, least = a, found.sum(1), label_a
            if right is not left:
                node, links, least = np.append(a, b), np.append(links, found.sum(0)), np.append(label_a, label_b)
            keep = links > 0
            return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (node, links.astype(np.int64), least)],
                                              ["node", "links", "least"])

        for batch in batches:
            for m, side, node, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if m != meeting:
                    if held:
                        yield one()
                    meeting, held = m, []
                if not held or held[-1][1] != node:
                    held.append((side, node, np.frombuffer(raw, "<u8")))
        if held:
            yield one()

    return full.join(broadcast_if_small(roles, _SMALL), "node").select("meeting", "side", "node", "keys") \
        .repartition("meeting").sortWithinPartitions("meeting", "side", "node") \
        .mapInArrow(join, "node long, links long, least long")


def _full_sets(docs: DataFrame, sources: DataFrame, nodes: DataFrame, order: Order, n: int) -> DataFrame:
    """node, n, keys: the whole sets of ``nodes``, made again from the texts of
    their first rows; repeated rows with that id and text give copies."""
    wanted = written(sources.join(nodes, "node"), "wanted", "snappy")

    def sets(batches: Iterator) -> Iterator:
        import pyarrow as pa

        done = set()  # repeated rows: once for each task
        for batch in batches_of(batches, _CHUNK):
            rows, nodes = order.sets(batch.column(2), n), batch.column(0).to_pylist()
            keep = []
            for i, (k, s) in enumerate(zip(rows, batch.column(1).to_pylist(), strict=True)):
                if nodes[i] not in done and signature(k) == s:
                    done.add(nodes[i])
                    keep.append(i)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep, pa.int64())), pa.array([len(rows[i]) for i in keep], pa.int64()),
                 pa.array([rows[i].tobytes() for i in keep], pa.binary())], ["node", "n", "keys"])

    found = docs.withColumn("hash", F.xxhash64("text")).join(
        broadcast_if_small(wanted, _SMALL), (F.col("hash") == F.col("of_hash")) & F.col("doc_id").eqNullSafe(F.col("of_id")))
    return found.select("node", "sig", "text").mapInArrow(sets, "node long, n long, keys binary").dropDuplicates(["node"])


def _walk(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """a, b, linked of every pair: each centre's set walks the trees of its
    partners' sets. ``sets`` has (node, n, keys), whole or their beginnings."""
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    # What a node does: it is the centre of some blocks (b = -1), and a partner in others.
    partner = pairs.join(blocks, "a").select(
        F.col("b").alias("node"), "a", F.pmod(F.xxhash64("b"), "blocks").cast("int").alias("block"), "b")
    centre = blocks.select(F.col("a").alias("node"), "a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
                           .alias("block"), F.lit(-1).cast("long").alias("b"))
    roles = written(centre.unionByName(partner), "roles", "snappy")

    def join(batches: Iterator) -> Iterator:
        import pyarrow as pa

        group, probe, held = None, None, []

        def walk() -> pa.RecordBatch:
            ids = [h[0] for h in held]
            hit = np.zeros(len(ids), bool)
            hit[tree_join(probe[1], [h[2] for h in held], percent, probe[0], [h[1] for h in held])] = True
            return pa.RecordBatch.from_arrays([pa.array([group[0]] * len(ids), pa.int64()),
                                               pa.array(ids, pa.int64()), pa.array(hit)], ["a", "b", "linked"])

        for batch in batches:
            for a, block, b, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (a, block) != group:
                    if held:
                        yield walk()
                    group, held = (a, block), []
                if b < 0:
                    probe = (n, np.frombuffer(raw, "<u8"))
                elif not held or held[-1][0] != b:
                    held.append((b, n, np.frombuffer(raw, "<u8")))
        if held:
            yield walk()

    return sets.join(broadcast_if_small(roles, _SMALL), "node").select("a", "block", "b", "n", "keys") \
        .repartition("a", "block").sortWithinPartitions("a", "block", "b").mapInArrow(
        join, "a long, b long, linked boolean")
