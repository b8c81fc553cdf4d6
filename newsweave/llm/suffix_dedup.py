"""Removal of repeated byte strings by suffix arrays.

A byte goes if it lies in a string of ``length`` bytes that also starts earlier
in the corpus: in a document before its own, or earlier in the same document.
Documents come in ascending id; matches never cross them.

Shards: every window of ``length`` bytes has an owner, the leftmost of its
``GRAM``-byte strings with the least hash. Equal windows have equal owners at
the same place, so windows are dealt to shards by their owner's hash and equal
ones always meet. Owners that occur once in the corpus are left aside: no
window of theirs is repeated. Of the others, each occurrence stands for the piece
of text that its windows cover; equal pieces of one owner (by a 64-bit hash
besides the owner's) are one piece from there on, at its first place. Two
windows of one piece are never equal, since they hold the owner at different
places, so all windows of the later copies are repeated.

A shard's text is its distinct pieces, one behind the other, of owners that have
more than one. Of these, only windows are kept whose middle part, the owner and
what all windows of a step of ``CORE_STEP`` places have around it, stands in another
piece of the owner too (by a 64-bit hash); no other window can be repeated. Its suffixes are
sorted by ``induced_sort`` with their common prefixes, on disk where they
exceed the memory: neighbours that share ``length`` bytes are equal windows,
and all but the first of them in the corpus are repeated.

Hot owners, with more than ``HOT`` distinct pieces (a passage that many
documents quote, where it meets their own text), are dealt again: their windows
by place in steps of ``STEPS`` bytes and by the bytes that all windows of a
step share, at last each window by itself. So no owner fills a shard alone.

Whole copies of a document are found first by their digests; all their bytes
are repeated if there are ``length`` of them.

Nulls: a null text is empty; a null id comes before all others. Repeated ids:
each row is a document of its own, ordered by its place in the table. Texts shorter than
``length`` bytes stay as they are. Empty table: no rows. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import distributed_row_number
from ..session import broadcast_if_small
from .common import batches_of, n_tasks, worker_cache, written
from .induced_sort import MEMORY, Disk, sorted_suffixes
from .words import mixed, powers

LENGTH = 100
GRAM = 40
#: Distinct pieces of one owner before its windows are dealt one by one.
HOT = 4096
STEPS = (8, 1)
#: Places of the owner in a window that are looked at together before the sort.
CORE_STEP = 10
#: Windows looked at in one go.
_CHUNK = 1 << 18
#: Broadcast bound of tables that grow with the corpus.
_SMALL = 8 << 20
#: The same for the owners that occur more than once, 8 bytes each: beyond it
#: all owners are shuffled once more.
_SHARED = 32 << 20
_BASE = 0x9E3779B97F4A7C15 | 1


def _tables():
    """Powers of the base and of its inverse modulo 2**64."""
    n = _CHUNK + 512
    return powers(n, _BASE), powers(n, pow(_BASE, -1, 1 << 64))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * worker_cache(("powers", _CHUNK), _tables)[0][:len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes from ``start`` to ``end``."""
    return mixed((sums[end] - sums[start]) * worker_cache(("powers", _CHUNK), _tables)[1][start])


def owners(hashes: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of every ``width`` hashes, the leftmost of equal
    ones, by windows of doubled width."""
    value, place, have = (hashes >> np.uint64(32)).astype(np.uint32), np.arange(len(hashes), dtype=np.int32), 1
    while have < width:
        step = min(have, width - have)
        a, b = value[:-step], value[step:]
        right = b < a
        place = np.where(right, place[step:], place[:-step])
        value = np.minimum(a, b)
        have += step
    return place


def _flat(column):
    """All bytes of a string or binary column, and where each row begins."""
    import pyarrow as pa

    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def owner_runs(data: np.ndarray, at: np.ndarray, length: int, gram: int) -> Iterator[tuple]:
    """Runs of windows with one owner: (hash of the owner, hash of the piece that
    the run covers, row, first window of the run in its row, number of windows, the
    owner's distance from the first). ``at`` says where each row begins."""
    for a in range(0, len(data) - length + 1, _CHUNK):
        part = data[a:a + _CHUNK + length - 1]
        sums = prefix_sums(part)
        down = worker_cache(("powers", _CHUNK), _tables)[1]
        h = mixed((sums[gram:] - sums[:-gram]) * down[:len(part) - gram + 1])
        own = owners(h, length - gram + 1)[:len(part) - length + 1]
        first = np.arange(a, a + len(own))
        row = np.searchsorted(at, first, "right") - 1
        inside = first + length <= at[row + 1]
        first, row, own = first[inside], row[inside], own[inside]
        if not len(first):
            continue
        new = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (row[1:] != row[:-1])))
        n = np.diff(np.append(new, len(first)))
        begin = first[new] - a
        piece = mixed(span_hashes(sums, begin, begin + n + length - 1) + n.astype(np.uint64))
        yield h[own[new]], piece, row[new], first[new] - at[row[new]], n, own[new] - begin


def core_hashes(data: np.ndarray, at: np.ndarray, owner: np.ndarray, away: np.ndarray, length: int,
                gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Per piece, and step of places of the owner in a window: the hash of the
    bytes that all windows of the step share, and whether the piece has such a
    window. Equal windows of an owner have equal hashes."""
    wide, sums, middle = length - gram, prefix_sums(data), at[:-1] + away
    salt = owner.view(np.uint64) * np.uint64(_BASE)
    steps = range(0, wide + 1, CORE_STEP)
    out, has = np.zeros((len(owner), len(steps)), np.uint64), np.zeros((len(owner), len(steps)), bool)
    for c, least in enumerate(steps):
        right = gram + wide - min(wide, least + CORE_STEP - 1)
        i = np.flatnonzero((away >= least) & (middle + right <= at[1:]))
        out[i, c] = mixed(span_hashes(sums, middle[i] - least, middle[i] + right) + salt[i])
        has[i, c] = True
    return out, has


def met_twice(hashes: np.ndarray, has: np.ndarray) -> np.ndarray:
    """Which of the hashes of ``core_hashes`` occur in more than one piece."""
    out = np.zeros(has.shape, bool)
    for c in range(has.shape[1]):
        i = np.flatnonzero(has[:, c])
        order = i[np.argsort(hashes[i, c])]
        same = hashes[order[1:], c] == hashes[order[:-1], c]
        out[order[1:][same], c] = True
        out[order[:-1][same], c] = True
    return out


def kept_windows(met: np.ndarray, away: np.ndarray, windows: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows of the steps that ``met`` names: (piece, first window in
    the piece, number of windows)."""
    edges = np.zeros((met.shape[0], met.shape[1] + 2), np.int8)
    edges[:, 1:-1] = met
    edges = np.diff(edges, axis=1)
    piece, low = np.nonzero(edges == 1)
    high = np.nonzero(edges == -1)[1]
    least = np.maximum(low * CORE_STEP, away[piece] - windows[piece] + 1)
    most = np.minimum(np.minimum(high * CORE_STEP - 1, length - gram), away[piece])
    return piece, away[piece] - most, most - least + 1


def _marks(padded: np.ndarray, windows: np.ndarray, places: np.ndarray, length: int, disk: Disk,
           memory: int) -> np.ndarray:
    """A byte for each window of a shard's pieces, 1 if it also starts earlier
    in the corpus. ``padded`` holds the pieces as bytes + 2, each with a 1 behind
    it, the end symbol and padding; ``windows`` and ``places`` are the pieces'
    numbers of windows and places in the corpus."""
    sizes = windows + length  # bytes of the piece and the mark behind it
    starts, begin = np.cumsum(sizes) - sizes, np.cumsum(windows) - windows
    out = disk.array(int(windows.sum()), np.uint8)
    piece_at = disk.array(int(sizes.sum()), np.int32)  # the piece of each byte
    for a in range(0, len(sizes), 1 << 14):
        b = min(len(sizes), a + (1 << 14))
        piece_at[starts[a]:starts[b - 1] + sizes[b - 1]] = np.repeat(np.arange(a, b, dtype=np.int32), sizes[a:b])
    best = slot = None  # of the open group: its first place in the corpus and which window that is
    for pos, shared in sorted_suffixes(padded, length, disk, memory):
        piece = piece_at[pos]
        off = pos - starts[piece]
        real = off < windows[piece]
        group = np.cumsum(shared < length)  # 0: the group left open by the last batch
        g, piece, off = group[real], piece[real], off[real]
        place, where = places[piece] + off, begin[piece] + off
        if best is not None:
            g, place, where = np.append(0, g), np.append(best, place), np.append(slot, where)
        best = None
        if len(g):
            first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            least = np.repeat(np.minimum.reduceat(place, first), np.diff(np.append(first, len(g))))
            later = place != least  # places are unique
            out[where[later]] = 1
            if g[-1] == group[-1]:
                k = first[-1] + int(np.argmin(place[first[-1]:]))
                best, slot = place[k], where[k]
    return out


def _runs(marks: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of ones begin and how long they are; none goes over one of
    ``starts``."""
    edge = np.zeros(len(marks) + 1, bool)
    edge[starts] = True
    edge[[0, -1]] = True
    one = marks == 1
    begin = one & (edge[:-1] | np.append(True, ~one[:-1]))
    end = one & (edge[1:] | np.append(~one[1:], True))
    where = np.flatnonzero(begin)
    return where, np.flatnonzero(end) - where + 1


def _place_bits(spark, texts: DataFrame) -> int:
    """Bits for a place within a text; the text's number takes the rest."""
    longest = texts.agg(F.max("bytes")).first()[0] or 0
    return max(8, int(longest).bit_length())


def repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text",
             hot: int = HOT, memory: int = MEMORY) -> tuple[DataFrame, DataFrame]:
    """The documents (row, doc_id, text, bytes), and their repeated windows as
    runs (row, at, n): windows at, ..., at + n - 1 also start earlier."""
    spark = docs.sparkSession
    texts = written(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"),
                                F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
                    .withColumn("bytes", F.octet_length("text")), "texts")
    narrow = texts.select(F.lit(0).alias("k"), "row", "doc_id", "bytes", F.unhex(F.sha2("text", 256)).alias("digest"))
    numbered = distributed_row_number(narrow, ["k"], [F.col("doc_id"), F.col("row")], "number")
    bits = _place_bits(spark, texts)
    if numbered.count() >= 1 << (63 - bits):
        raise ValueError("places of all texts don't fit in 63 bits")
    firsts = numbered.groupBy("digest").agg(F.min("number").alias("first"))
    order = written(numbered.join(firsts, "digest").select("row", "number", "bytes", (F.col("number") > F.col("first"))
                                                           .alias("copy")), "order", "snappy")
    copies = order.where(F.col("copy") | (F.col("bytes") < length)).select("row")

    originals = texts.join(broadcast_if_small(copies, _SMALL), "row", "left_anti").select("row", "text")

    def owners_of(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches_of(batches, 4 << 20):
            for h, *_ in owner_runs(*_flat(batch.column(0)), length, gram):
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["owner"])

    def runs(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches_of(batches, 4 << 20):
            rows = batch.column(0).to_numpy()
            for h, piece, row, at, n, away in owner_runs(*_flat(batch.column(1)), length, gram):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(piece.view(np.int64)), pa.array(rows[row]), pa.array(at),
                     pa.array(n.astype(np.int32)), pa.array(away.astype(np.int32))],
                    ["owner", "sign", "row", "at", "n", "away"])

    shared = written(originals.select("text").mapInArrow(owners_of, "owner long").groupBy("owner").agg(F.count("*").alias("of"))
                     .where("of > 1").select("owner"), "shared", "snappy")
    place = (F.shiftleft("number", bits) + F.col("at")).alias("place")
    met = written(originals.mapInArrow(runs, "owner long, sign long, row long, at long, n int, away int")
                  .join(broadcast_if_small(shared, _SHARED), "owner")
                  .join(broadcast_if_small(order.select("row", "number"), _SMALL), "row")
                  .select("owner", "sign", "row", place, "n", "away"), "met")
    firsts = written(met.groupBy("owner", "sign").agg(F.min("place").alias("place")), "first-places")
    # a single piece of an owner has no other that its windows could stand in
    several = written(firsts.groupBy("owner").agg(F.count("*").alias("of")).where("of > 1")
                      .select("owner", F.lit(True).alias("several")), "several", "snappy")
    firsts = firsts.join(broadcast_if_small(several, _SHARED), "owner", "left") \
        .select("place", F.lit(True).alias("first"), F.coalesce("several", F.lit(False)).alias("several"))
    met = written(met.drop("sign").join(firsts, "place", "left"), "judged")
    later = met.where("first is null").select("place", "n")
    # a document's pieces are bounded by its length
    asked = met.where("several").groupBy("row").agg(F.collect_list(F.struct("owner", "place", "n", "away")).alias("runs"))

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches_of(batches, 4 << 20):
            raw, lists = batch.column(0).cast(pa.large_binary()), batch.column(1)
            flat, upto = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            owner, place, n, away = (flat.field(k) for k in range(4))
            a, b, out = (place.to_numpy() & ((1 << bits) - 1)).tolist(), n.to_pylist(), []
            for i, text in enumerate(raw):
                t = text.as_py()
                out += [t[a[k]:a[k] + b[k] + length - 1] for k in range(upto[i], upto[i + 1])]
            yield pa.RecordBatch.from_arrays([owner, place, away, pa.array(out, pa.binary())],
                                             ["owner", "place", "away", "piece"])

    shards = texts.select("row", "text").join(asked, "row").select("text", "runs") \
        .mapInArrow(cut, "owner long, place long, away int, piece binary")
    if met.where("several").groupBy("owner").count().where(F.col("count") > hot).take(1):
        shards = written(shards, "pieces")
    else:
        hot = None  # no owner is
    for step in STEPS if hot is not None else ():
        many = shards.groupBy("owner").agg(F.count("*").alias("of")).where(F.col("of") > hot).select("owner")
        many = written(many, "hot-owners", "snappy")
        if not many.take(1):
            break
        few, more = _distinct(_dealt(shards.join(broadcast_if_small(many, _SMALL), "owner"), step, length), length)
        shards = written(shards.join(broadcast_if_small(many, _SMALL), "owner", "left_anti").unionByName(few), "dealt")
        later = later.unionByName(more)

    def sort(batches: Iterator) -> Iterator:
        import pyarrow as pa

        disk = Disk(memory)
        log, parts, hashes = disk.log(), [], []
        for batch in batches_of(batches, 1 << 17):
            data, at = _flat(batch.column(3))
            owner, place, away = (batch.column(k).to_numpy() for k in range(3))
            parts.append((log.append(data), at, place, away.astype(np.int64)))
            hashes.append(core_hashes(data, at, owner, parts[-1][3], length, gram))
        if not parts:
            return
        met = met_twice(*(np.concatenate(h) for h in zip(*hashes, strict=True)))
        del hashes
        cuts, begin = [], 0
        for _, at, _, away in parts:
            cuts.append(kept_windows(met[begin:begin + len(away)], away, np.diff(at) - (length - 1), length, gram))
            begin += len(away)
        del met
        n = np.concatenate([c[2] for c in cuts])
        if not len(n):
            return
        padded = disk.array(int(n.sum()) + length * len(n) + 1 + length + 8, np.uint8)
        begin, places = 0, []
        for (where, at, place, _), (piece, off, wide) in zip(parts, cuts, strict=True):
            data, size = log.read(where), wide + (length - 1)
            if len(data) and data.max() > 253:
                raise ValueError("text is not UTF-8")
            upto = np.cumsum(size)
            inner = np.arange(int(size.sum()))
            to = begin + inner + np.repeat(np.arange(len(size)), size)
            end = begin + len(inner) + len(size)
            padded[begin:end] = 1
            padded[to] = data[inner + np.repeat(at[piece] + off - (upto - size), size)] + np.uint8(2)
            begin = end
            places.append(place[piece] + off)
        place = np.concatenate(places)
        marks = _marks(padded, n, place, length, disk, memory)
        upto = np.concatenate([[0], np.cumsum(n)])
        for a in range(0, len(n), 1 << 14):
            b = min(len(n), a + (1 << 14))
            starts = upto[a:b] - upto[a]
            where, size = _runs(np.asarray(marks[upto[a]:upto[b]]), starts)
            piece = np.searchsorted(starts, where, "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(place[a + piece] + where - starts[piece]), pa.array(size, pa.int32())],
                                             ["place", "n"])

    # some 130 bytes a piece
    tasks = n_tasks(spark, 130 * met.where("several").count())
    found = shards.select("owner", "place", "away", "piece").repartition(tasks, "owner") \
        .mapInArrow(sort, "place long, n int")
    spans = later.unionByName(found) \
        .select(F.shiftright("place", bits).alias("number"), F.col("place").bitwiseAND((1 << bits) - 1).cast("int").alias("at"),
                "n")
    by_row = spans.join(broadcast_if_small(order.select("row", "number"), _SMALL), "number").select("row", "at", "n")
    whole = order.where(F.col("copy") & (F.col("bytes") >= length)) \
        .select("row", F.lit(0).alias("at"), (F.col("bytes") - (length - 1)).cast("int").alias("n"))
    return texts, by_row.unionByName(whole)


def _dealt(pieces: DataFrame, step: int, length: int) -> DataFrame:
    """The pieces of hot owners cut into their windows, ``step`` at a time by
    distance from the owner; the new owner is the bytes that these share."""
    # d: how far a window's start is before its owner; away, away - 1, ..., last
    last = F.col("away") - (F.octet_length("piece") - length)
    each = pieces.withColumn("c", F.explode(F.sequence(F.floor(last / step), F.floor(F.col("away") / step))))
    nearest = F.col("c") * step
    far, near = F.least("away", nearest + (step - 1)), F.greatest(last, nearest)
    start = F.col("away") - far
    piece = F.substring("piece", (start + 1).cast("int"), (far - near + length).cast("int"))
    core = F.substring("piece", (F.col("away") - nearest + 1).cast("int"), F.lit(length - step + 1))
    return each.select(F.xxhash64("owner", "c", core).alias("owner"), (F.col("place") + start).alias("place"),
                       far.cast("int").alias("away"), piece.alias("piece"))


def _distinct(pieces: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Each owner's distinct pieces at their first places, and the windows of
    the later ones (place, n), which are all repeated."""
    pieces = written(pieces.withColumn("sign", F.xxhash64("piece")), "pieces")
    firsts = written(pieces.groupBy("owner", "sign", "away", "piece").agg(F.min("place").alias("place")), "distinct")
    later = pieces.join(firsts.select("owner", "sign", F.col("place").alias("first")), ["owner", "sign"]) \
        .where("place > first").select("place", (F.octet_length("piece") - (length - 1)).cast("int").alias("n"))
    return firsts.select("owner", "place", "away", "piece"), later


def remove(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text",
           hot: int = HOT, memory: int = MEMORY) -> DataFrame:
    """One row per document: doc_id, n_bytes, ``removed`` (the maximal runs of
    repeated bytes as start and end) and ``kept`` (the other bytes)."""
    texts, spans = repeated(docs, length, gram, id_col, text_col, hot, memory)
    # a document's runs are bounded by its length
    spans = spans.groupBy("row").agg(F.collect_list(F.struct("at", "n")).alias("runs"))

    def merge(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches_of(batches, 4 << 20):
            out = []
            for runs in batch.column(1).to_pylist():
                gone: list = []
                for a, b in sorted((r["at"], r["at"] + r["n"] + length - 1) for r in runs):
                    if gone and a <= gone[-1]["end"]:
                        gone[-1]["end"] = max(gone[-1]["end"], b)
                    else:
                        gone.append({"start": a, "end": b})
                out.append(gone)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["row", "removed"])

    kind = "array<struct<start: long, end: long>>"
    spans = written(spans.mapInArrow(merge, f"row long, removed {kind}"), "removed")

    def apply(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches_of(batches, 4 << 20):
            kept = []
            for text, gone in zip(batch.column(1).cast(pa.large_binary()), batch.column(2).to_pylist(), strict=True):
                raw, out, at = text.as_py(), [], 0
                for r in gone:
                    out.append(raw[at:r["start"]])
                    at = r["end"]
                kept.append(b"".join(out) + raw[at:])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), batch.column(2), pa.array(kept, pa.binary())],
                                             ["doc_id", "n_bytes", "removed", "kept"])

    id_type = texts.schema["doc_id"].dataType.simpleString()
    none = F.expr(f"cast(array() as {kind.replace(': ', ':')})")
    return texts.join(broadcast_if_small(spans, _SMALL), "row", "left") \
        .select("doc_id", "text", F.coalesce("removed", none).alias("removed"), F.col("bytes").cast("long").alias("bytes")) \
        .mapInArrow(apply, f"doc_id {id_type}, n_bytes long, removed {kind}, kept binary")
