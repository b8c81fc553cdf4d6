"""Language ID by nearest centroid over TF-IDF vectors of letter n-grams.

A text is lower-cased, every run of other signs becomes one blank, and its
1-, 2- and 3-grams are hashed into ``DIMS`` places. The vector holds
log(1 + count) * idf and has length 1. Every language has up to ``CENTROIDS``
centroids (spherical k-means over its fitted texts); a text gets the language
of the centroid with the largest cosine, which is its score.

Rejection is by distance: ``rejected`` if the cosine lies below ``SLACK``
times what the least similar per cent of fitted texts of about that length
reach (shorter texts are less similar to any centroid). A text without letters
is ``und``, score 0, and rejected.

Fitting takes at most about ``fit_rows`` labelled texts of a language, chosen
by a hash of id and text at a rate from the language's row count: a bounded
sample as a documented parameter; the document frequencies of the idf are counted over all
labelled texts. Prediction reads every whole text. Long texts are
counted in slices, so memory is the text and one vector of DIMS. A fitting task
holds one matrix of its sample's vectors, a predicting one that of a block.

Least cosines are learned from languages of ``MIN_FITTED`` fitted texts or more;
a length class without a text of theirs takes that of the next shorter one, or a
share of the next longer. Without any, distance rejects nothing. Equal cosines:
the language first in order wins.

Nulls: null or empty text is ``und``; rows without language are not fitted.
No labelled rows: everything is ``und``. Empty table: no rows. Other columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, release_worker_cache, written

DIMS = 4096
CENTROIDS = 3
FIT_ROWS = 3000
ROUNDS = 8
#: Fitted texts of a language from which its least cosines are learned.
MIN_FITTED = 20
SLACK = 0.5
UNKNOWN = "und"
#: Lengths are told apart by powers of two of the letters and blanks.
LENGTHS = 24

_OTHER = re.compile(r"[\W\d_]+")
_SLICE = 1 << 20
#: Bytes of texts taken from an Arrow batch at once.
_CHUNK = 4 << 20
#: Rows and columns of a matrix that are copied at once.
_PART = 256


def counts_of(text: str | None) -> tuple[np.ndarray, int] | None:
    """Counts of the hashed n-grams of a text, and its length in letters and
    blanks; None without letters."""
    if not text:
        return None
    clean = f" {_OTHER.sub(' ', text.lower()).strip()} "
    if len(clean) <= 2:
        return None
    total = np.zeros(DIMS, np.int64)
    for i in range(0, len(clean), _SLICE):
        c = np.frombuffer(clean[i:i + _SLICE + 2].encode("utf-32-le"), "<u4")
        own = min(_SLICE, len(clean) - i)
        one = c * np.uint32(2654435761)
        two = (one[:-1] ^ (c[1:] * np.uint32(2246822519))) * np.uint32(3266489917)
        three = (two[:-1] ^ (c[2:] * np.uint32(668265263))) * np.uint32(374761393)
        grams = np.concatenate([one[:own], two[:own], three[:own]]) >> np.uint32(20)  # 12 bits: DIMS
        total += np.bincount(grams, minlength=DIMS)
    return total, len(clean)


def unit_vectors(logs: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """``logs``, rows of log(1 + count), made unit vectors in place."""
    for i in range(0, len(logs), _PART):
        v = logs[i:i + _PART]
        v *= idf
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    return logs


def mean_of(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Mean of the chosen rows; a few columns of them are copied at once."""
    return np.concatenate([x[:, i:i + _PART][rows].mean(0) for i in range(0, x.shape[1], _PART)])


def length_class(n) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(n, 1)).astype(np.int64), LENGTHS - 1)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids; the first is the mean, each next one starts at the text
    farthest from those before."""
    norm = lambda m: m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-12)
    c = norm(x.mean(0, keepdims=True))
    while len(c) < min(k, len(x)):
        c = np.vstack([c, x[np.argmin((x @ c.T).max(1))]])
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        c = norm(np.vstack([mean_of(x, own == j) if (own == j).any() else c[j] for j in range(len(c))]))
    return c.astype(np.float32)


def features(docs: DataFrame, text_col: str, label: Column) -> DataFrame:
    """label, letters and the sparse counts (places, counts) of each text that
    has letters."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        release_worker_cache()
        for batch in batches_of(batches, _CHUNK):
            rows = []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if got := counts_of(text):
                    at = np.flatnonzero(got[0])
                    rows.append((lang, got[1], at.astype("<u2").tobytes(), got[0][at].astype("<u4").tobytes()))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.binary(), pa.binary()), strict=True)],
                ["label", "letters", "places", "counts"])

    return docs.select(label.cast("string").alias("label"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, "label string, letters long, places binary, counts binary")


class Model:
    """idf, unit centroids, their languages, and the least accepted cosine by
    length class."""

    def __init__(self, idf, centroids, langs, floor):
        self.idf, self.centroids, self.langs, self.floor = idf, centroids, langs, floor


def fit(docs: DataFrame, is_train: Column, fit_rows: int = FIT_ROWS, centroids: int = CENTROIDS,
        id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Centroids of the languages of the training rows. Of each language, a
    group of about ``fit_rows`` texts (at most) is in one task; the driver
    gets its centroids."""
    spark = docs.sparkSession
    train = docs.where(is_train & F.col(lang_col).isNotNull())
    sizes = {r[0]: r[1] for r in train.groupBy(F.col(lang_col).cast("string").alias("l")).count().collect()}
    if not sizes:
        return None
    rate = F.lit(0.0)
    for lang, n in sizes.items():
        rate = F.when(F.col(lang_col).cast("string") == lang, F.lit(min(1.0, fit_rows / n))).otherwise(rate)
    # Id and text together: rows without id, or with one id, have hashes of their own.
    at = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit("fit")), F.lit(1 << 30)) / float(1 << 30)
    sample = written(features(train.where(at < rate), text_col, F.col(lang_col)), "langid")

    # Document frequencies are those of all training texts; only the k-means takes the sample.
    def places(batches: Iterator) -> Iterator:
        import pyarrow as pa

        release_worker_cache()
        n = np.zeros(DIMS + 1, np.int64)
        for batch in batches_of(batches, _CHUNK):
            for x in batch.column(0).to_pylist():
                if got := counts_of(x):
                    n[:DIMS] += got[0] > 0
                    n[DIMS] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS + 1), pa.int32()), pa.array(n)], ["place", "n"])

    seen = np.zeros(DIMS + 1)
    for r in train.select(F.col(text_col).cast("string")).mapInArrow(places, "place int, n long").groupBy("place") \
            .agg(F.sum("n").alias("n")).collect():
        seen[r["place"]] = r["n"]
    if not seen[DIMS]:
        return None
    idf = np.log((1 + seen[DIMS]) / (1 + seen[:DIMS])).astype(np.float32) + 1

    def learn(key, table):
        import pyarrow as pa

        release_worker_cache()
        x = np.zeros((table.num_rows, DIMS), np.float32)
        for i, (p, c) in enumerate(zip(table["places"], table["counts"], strict=True)):
            x[i, np.frombuffer(p.as_buffer(), "<u2")] = np.log1p(np.frombuffer(c.as_buffer(), "<u4").astype(np.float32))
        x = unit_vectors(x, idf)
        c = spherical_kmeans(x, centroids)
        size, best = length_class(table["letters"].to_numpy()), (x @ c.T).max(1)
        some = len(best) >= MIN_FITTED
        low = [float(np.quantile(best[size == k], 0.01)) if some and (size == k).any() else None for k in range(LENGTHS)]
        return pa.table({"label": [key[0].as_py()] * len(c), "centroid": [v.astype("<f4").tobytes() for v in c],
                         "low": [low] * len(c)},
                        schema=pa.schema([("label", pa.string()), ("centroid", pa.binary()),
                                          ("low", pa.list_(pa.float64()))]))

    got = sample.groupBy("label").applyInArrow(learn, "label string, centroid binary, low array<double>").collect()
    if not got:
        return None
    got.sort(key=lambda r: (r["label"], r["centroid"]))
    floor = np.array([min([r["low"][k] for r in got if r["low"][k] is not None], default=np.nan)
                      for k in range(LENGTHS)])
    known = np.flatnonzero(~np.isnan(floor))
    for k in range(LENGTHS):  # lengths without a fitted text: as the next shorter one, or a half of the next longer
        if np.isnan(floor[k]) and len(known):
            below = known[known < k]
            floor[k] = floor[below[-1]] if len(below) else floor[known[0]] / 2.0 ** (known[0] - k)
    return Model(idf, np.vstack([np.frombuffer(r["centroid"], "<f4") for r in got]), [r["label"] for r in got],
                 SLACK * np.minimum.accumulate(floor[::-1])[::-1])


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", block: int = 512) -> DataFrame:
    """``docs`` with lang_pred, score and rejected; nothing but the text is
    looked at."""
    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

    schema = StructType(list(docs.schema.fields)).add("lang_pred", StringType()).add("score", DoubleType()) \
        .add("rejected", BooleanType())
    at = docs.columns.index(text_col)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        release_worker_cache()
        for batch in batches_of(batches, _CHUNK):
            langs, scores, out = [], [], []
            column = batch.column(at)
            for i in range(0, batch.num_rows, block):
                n = min(block, batch.num_rows - i)
                lang, score, no = [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
                x, has, letters = np.empty((n if model else 0, DIMS), np.float32), [], []
                for k, text in enumerate(column.slice(i, block).to_pylist() if model else []):
                    if got := counts_of(text):
                        x[len(has)] = np.log1p(got[0])
                        has.append(k)
                        letters.append(got[1])
                if has:
                    sim = unit_vectors(x[:len(has)], model.idf) @ model.centroids.T
                    best = sim.argmax(1)
                    top = np.clip(sim[np.arange(len(has)), best].astype(float), 0, 1)
                    score[has] = top
                    no[has] = top < model.floor[length_class(letters)]
                    for k, b in zip(has, best, strict=True):
                        lang[k] = model.langs[b]
                langs += lang
                scores.append(score)
                out.append(no)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(np.concatenate(scores)),
                 pa.array(np.concatenate(out))], [*batch.schema.names, "lang_pred", "score", "rejected"])

    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Documents whose crc32(doc_id as text) mod 4 is 2; a null id is not held
    out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
