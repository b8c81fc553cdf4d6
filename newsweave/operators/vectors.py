"""Headline vectors and the in-slot similarity join.

* ``title_tokens``   H6-H8: one row per (article, token position, clean word)
* ``vocabulary``     words seen in >= 2 titles, each with a vector id
* ``token_vectors``  J5: token -> vector id, out-of-vocabulary -> ``<unk>`` (0)
* ``title_bags``, ``bag_vectors`` A5: component-wise mean of the token vectors,
  once per distinct multiset of vector ids
* ``similar_pairs``  J6: pairs of one slot with cosine distance < threshold

Scale notes: titles with the same vector ids have the same vector, so copies
of a headline are one node of the pair join (``clusters.view_nodes``), and a
group of K copies costs K rows instead of K * (K - 1) / 2 pairs. The
vocabulary and embedding lookups are joins (broadcast only behind a size
check); the unknown-word vector is a scalar. The mean is a plain hash
aggregate with one sum per dimension, so it combines map-side. The pair join is quadratic inside a slot;
large slots are split into ``S`` hash blocks and every block pair becomes its
own group, which spreads one hot slot over ``S*(S+1)/2`` tasks while every
pair is still compared exactly once (no pair is skipped). Inside a group the
distances are dense matrix products of a few rows at a time (numpy), so the
pairs held at once are bounded too, since Spark has no vector dot-product expression and the
lambda-based array expressions are interpreted row by row. Vectors are scaled
there as well: a norm inside a lambda is computed again for every component.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_word, tokenise
from ..session import broadcast_if_small, checkpoint

SLOT = ["digest_date", "part"]
UNK_VEC_ID = 0
# Cosine distance below which two headlines may share a story.
DISTANCE_THRESHOLD = 0.3
# Articles per block in the pair join; a slot larger than this is split. Every
# article is sent once for each block of its slot.
PAIR_BLOCK_ROWS = 16000
# Blocks are dealt by hash, so some hold more rows than others; a place in a
# block has 16 bits.
MAX_BLOCK_ROWS = 32000
# Rows and columns of two blocks that are multiplied at a time.
PAIR_TILE_ROWS = 500
PAIR_TILE_COLUMNS = 2000


def title_tokens(articles: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys..., index, pos, word): whitespace tokens of the title, cleaned.
    A token that cleans to '' is kept (it counts as ``<unk>``)."""
    keys = keys if keys is not None else SLOT
    return (articles.select(*keys, "index", F.posexplode(tokenise("title")).alias("pos", "tok"))
            .select(*keys, "index", "pos", clean_word("tok").alias("word")))


def vector_id(word: Column, n_vectors: int) -> Column:
    """Stable md5-based id in ``[0, n_vectors)``."""
    h = F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("bigint")
    return F.pmod(h, F.lit(n_vectors))


def vocabulary(tokens: DataFrame, n_vectors: int, min_titles: int = 2) -> DataFrame:
    """(word, vec_id): non-empty words in at least ``min_titles`` titles.
    Distinct (word, index) first, then a count with map-side combine, so a
    very common word does not gather its rows in one task."""
    return (tokens.where(F.col("word") != "")
            .select("word", "index").distinct()
            .groupBy("word").agg(F.count("*").alias("n_titles"))
            .where(F.col("n_titles") >= min_titles)
            .select("word", vector_id(F.col("word"), n_vectors).alias("vec_id")))


def token_vectors(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """Adds ``vec_id`` to every token (OOV and '' -> 0). Vectors are not
    attached here: a vector is read once per distinct title (``bag_vectors``),
    not once per token."""
    return (tokens.join(broadcast_if_small(vocab), "word", "left")
            .withColumn("vec_id", F.coalesce("vec_id", F.lit(UNK_VEC_ID))))


def title_bags(token_vecs: DataFrame) -> DataFrame:
    """(index, bag): the title's vector ids in order, as often as they occur.
    Titles are short, so a bag is bounded. Articles without tokens have none."""
    return token_vecs.groupBy("index").agg(F.array_sort(F.collect_list("vec_id")).alias("bag"))


def embedding_dim(embeddings: DataFrame) -> int:
    row = embeddings.select(F.size("embedding").alias("d")).first()
    return int(row["d"]) if row else 0


def bag_vectors(bags: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(bag, vec array<double>): mean vector of every distinct bag. The
    unknown-word vector, which a fifth of all tokens have, is one row added as
    a scalar; only known words meet the embeddings."""
    dim = embedding_dim(embeddings)
    unk = embeddings.where(F.col("vec_id") == UNK_VEC_ID).select("embedding").first()
    unk = [float(x) for x in unk["embedding"]] if unk else [0.0] * dim
    distinct = bags.select("bag").distinct()
    known = (distinct.select("bag", F.explode("bag").alias("vec_id"))
             .where(F.col("vec_id") != UNK_VEC_ID)
             .groupBy("bag", "vec_id").agg(F.count("*").alias("n")))
    emb = embeddings.select("vec_id", F.col("embedding").alias("e"))
    sums = (known.join(broadcast_if_small(emb), "vec_id").groupBy("bag")
            .agg(*[F.sum(F.col("n") * F.col("e")[i].cast("double")).alias(f"_d{i}") for i in range(dim)]))
    n_unk = F.size(F.filter("bag", lambda v: v == UNK_VEC_ID))
    comps = [(F.coalesce(F.col(f"_d{i}"), F.lit(0.0)) + n_unk * F.lit(unk[i])) / F.size("bag") for i in range(dim)]
    return distinct.join(sums, "bag", "left").select("bag", F.array(*comps).alias("vec"))


def rounded(d):
    """Distances to 6 decimals. Halves go up with a margin, so that a distance
    that is a half in exact arithmetic falls to the same side in any engine."""
    import numpy as np

    return np.floor(d * 1e6 + 0.501) / 1e6


def unit_rows(vec):
    """The rows that have a direction (a mask), and those scaled to unit length."""
    import numpy as np

    norm = np.sqrt((vec * vec).sum(axis=1))
    ok = norm > 0
    return ok, vec[ok] / norm[ok][:, None]


def near_pairs(left, right, threshold: float, same: bool):
    """For ``PAIR_TILE_ROWS`` rows of ``left`` at a time the positions in both
    blocks of the pairs below the threshold, and their distances; in one block
    (``same``) each pair once. ``PAIR_TILE_COLUMNS`` columns are multiplied at
    a time, and only pairs near the threshold are rounded."""
    import numpy as np

    for at in range(0, len(left) if len(right) else 0, PAIR_TILE_ROWS):
        found = []
        for of in range(at if same else 0, len(right), PAIR_TILE_COLUMNS):
            gram = left[at:at + PAIR_TILE_ROWS] @ right[of:of + PAIR_TILE_COLUMNS].T
            near = gram > 1.0 - threshold - 1e-5
            if same and of < at + PAIR_TILE_ROWS:
                near = np.triu(near, k=at - of + 1)
            cell = np.flatnonzero(near)
            d = rounded(1.0 - gram.ravel()[cell])
            below = d < threshold
            i, j = np.divmod(cell[below], gram.shape[1])
            found.append((at + i, of + j, d[below]))
        yield tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _block_pairs(batches: Iterator[pa.RecordBatch], threshold: float):
    """One (slot, block pair) group: both block numbers, their unit vectors
    with their ids in rising order, and the first row."""
    import numpy as np

    table = pa.Table.from_batches(list(batches)).combine_chunks()
    lo, hi = table["_lo"][0].as_py(), table["_hi"][0].as_py()
    ok, u = unit_rows(table["vec"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1))
    idx, blk = table["index"].to_numpy()[ok], table["_blk"].to_numpy()[ok]
    order = np.argsort(idx)
    left, right = (order[blk[order] == x] for x in (lo, hi))
    return lo, hi, idx[left], idx[right], near_pairs(u[left], u[right], threshold, lo == hi), table.slice(0, 1)


def _block_pairs_fn(keys: list[str], threshold: float):
    """Per (slot, block pair) group: the pairs (a < b) below the threshold, one
    batch for some rows of the left block."""
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, left, right, tiles, one = _block_pairs(batches, threshold)
        first = [one[k].combine_chunks() for k in keys]
        for i, j, d in tiles:
            if len(d):
                i, j, same = left[i], right[j], pa.array(np.zeros(len(d), "int32"))
                yield pa.RecordBatch.from_arrays(
                    [*[k.take(same) for k in first], pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j)), pa.array(d)],
                    [*keys, "a", "b", "d"])

    return run


def _packed_pairs_fn(keys: list[str], threshold: float):
    """Per (slot, block pair) group: the same pairs as places in the two blocks
    (whose ids rise) and millionths, eight bytes a pair; ``ids`` of a block
    come once, with its pairs among themselves."""
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, hi, left, _, tiles, one = _block_pairs(batches, threshold)
        first = [one[k].combine_chunks() for k in keys]
        blocks = [pa.array([x], pa.int32()) for x in (lo, hi)]

        def row(*data):
            cells = [pa.array([None if x is None else x.tobytes()], pa.binary()) for x in data]
            return pa.RecordBatch.from_arrays([*first, *blocks, *cells], [*keys, "lo", "hi", "ids", "i", "j", "d"])

        if lo == hi:
            yield row(left.astype("int64"), None, None, None)
        for i, j, d in tiles:
            if len(d):
                yield row(None, i.astype("uint16"), j.astype("uint16"), np.rint(d * 1e6).astype("int32"))

    return run


def similar_pairs(vectors: DataFrame, threshold: float = DISTANCE_THRESHOLD,
                  block_rows: int = PAIR_BLOCK_ROWS, keys: list[str] | None = None) -> DataFrame:
    """(keys..., a, b, d) for a < b in the same slot with d < threshold;
    d is rounded to 6 decimals so that ties are stable across engines.

    A slot of n articles is split into S = ceil(n / block_rows) hash blocks;
    each article is sent to the S block pairs it takes part in, and each
    (slot, block pair) group computes its distances as matrix products.
    Every pair is compared in exactly one group, a group holds at most
    2 * block_rows articles, and only pairs below the threshold leave it."""
    keys = keys if keys is not None else SLOT
    schema = T.StructType([*[vectors.schema[k] for k in keys],
                           T.StructField("a", T.LongType()), T.StructField("b", T.LongType()),
                           T.StructField("d", T.DoubleType())])
    pairs = _block_pairs_fn(keys, threshold)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in pairs(pa.RecordBatch.from_pandas(f, preserve_index=False) for f in frames):
            yield batch.to_pandas()

    return _by_block_pair(vectors, block_rows, keys).applyInPandas(run, schema)


def packed_pairs(vectors: DataFrame, threshold: float = DISTANCE_THRESHOLD,
                 block_rows: int = PAIR_BLOCK_ROWS, keys: list[str] | None = None) -> DataFrame:
    """The pairs of ``similar_pairs`` for the tasks that merge them: (keys...,
    lo, hi, ids, i, j, d), see ``_packed_pairs_fn``."""
    keys = keys if keys is not None else SLOT
    if block_rows > MAX_BLOCK_ROWS:
        raise ValueError(f"places in a block have 16 bits: at most {MAX_BLOCK_ROWS} rows")
    schema = T.StructType([*[vectors.schema[k] for k in keys], T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType()),
                           *[T.StructField(c, T.BinaryType()) for c in ("ids", "i", "j", "d")]])
    return _by_block_pair(vectors, block_rows, keys).applyInArrow(_packed_pairs_fn(keys, threshold), schema)


def _by_block_pair(vectors: DataFrame, block_rows: int, keys: list[str]):
    # zero vectors are dropped: their distance is undefined, they stay singletons
    u = vectors.where(F.exists("vec", lambda x: x != 0)).select(*keys, "index", "vec")
    sizes = (u.groupBy(*keys).agg(F.count("*").alias("_n"))
             .select(*keys, F.greatest(F.lit(1), F.ceil(F.col("_n") / block_rows)).cast("int").alias("_s")))
    # one row per slot: bounded by the number of slots, checked before broadcast
    blocked = (u.join(broadcast_if_small(sizes), keys)
               .withColumn("_blk", F.pmod(F.xxhash64("index"), F.col("_s")).cast("int")))
    fan = blocked.select(*keys, "index", "vec", "_blk",
                         F.explode(F.sequence(F.lit(0), F.col("_s") - 1)).alias("_k"))
    fan = fan.select(*keys, "index", "vec", "_blk",
                     F.least("_blk", "_k").alias("_lo"), F.greatest("_blk", "_k").alias("_hi"))
    return fan.groupBy(*keys, "_lo", "_hi")


def title_vectors(articles: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Titles -> tokens -> vocabulary -> bags -> vectors: (index, bag, vec)."""
    # tokens feed both the vocabulary and the lookup: written once (one row
    # per title token) instead of tokenising the titles twice
    toks = checkpoint(title_tokens(articles, []), "tokens")
    vocab = vocabulary(toks, embeddings.count())
    bags = checkpoint(title_bags(token_vectors(toks, vocab)), "bags")
    return bags.join(bag_vectors(bags, embeddings), "bag").select("index", "bag", "vec")
