"""Token-ID output as static range asymmetric numeral system (rANS) files.

Every document's ids plus one end id form one stream in ascending document
order. One frequency table over the whole stream is shared by all blocks. A
block holds up to ``BLOCK`` ids and is coded on its own with ``LANES``
interleaved states, so a task codes many blocks at once, a step of all lanes
of all blocks per vector operation. Inside a block, a checkpoint every
``SEGMENT`` ids keeps the lanes' states and the place in the word stream:
segments decode in parallel without the part before them. A block carries the
CRC-32 of its payload and of its ids; decoding checks both.

The files are Parquet tables with one row per block (``part``, ``first``,
``n_ids``, ``docs``, ``payload``), so any file system that Spark knows holds
them, writes are committed as a whole and a lost task is run again alone. File
k holds smaller ``doc_id`` than file k + 1, and blocks ascend inside a file.

    payload: magic "RNS1" | lanes u16 | segment u16 | n_ids u32 | n_words u32
             | crc32 of ids u32 | per segment: word offset u32, lane states u64
             | words u32 ... | crc32 of all before u32      (little-endian)

Nulls: null text counts as empty, so its stream is the end id alone; a null
``doc_id`` sorts first and is returned as null. Repeated ``doc_id``: every row
has its own place in the stream; ties go by a hash of
their ids. Empty
table: no blocks, no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import estimated_bytes
from .common import (batches_of, crc32_shift, crc32_zero_operators, n_tasks, shared_path, word_tokenizer,
                     worker_cache)

LANES = 32
SEGMENT = 8192
BLOCK = 65536
#: Bits of the frequency scale; the state stays in [2**31, 2**63).
SCALE_BITS = 18
MAGIC = b"RNS1"

TOKENS = "doc_id long, n_tokens long, ids binary"
BLOCKS = "part int, first long, n_ids long, docs binary, payload binary"


# ------------------------------------------------------------- tables

def scaled_frequencies(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Counts scaled to the sum 2**bits; every id that occurs keeps at least 1.
    The rounding error goes to the largest ones."""
    total, scale = int(counts.sum()), 1 << bits
    freq = np.zeros(len(counts), np.int64)
    if not total:
        return freq
    used = np.flatnonzero(counts)
    if len(used) > scale:
        raise ValueError(f"{len(used)} ids need more than {bits} bits")
    freq[used] = np.maximum(1, (counts[used].astype(object) * scale // total).astype(np.int64))
    order = used[np.argsort(-freq[used], kind="stable")]
    off = scale - int(freq.sum())
    if off > 0:
        freq[order[0]] += off
    while off < 0:  # take from the largest, never below 1
        for s in order:
            take = min(-off, max(0, int(freq[s]) // 2 if -off > 1 else int(freq[s]) - 1))
            freq[s] -= take
            off += take
            if not off:
                break
    return freq


class Tables:
    """What coding and decoding look up, from the scaled frequencies."""

    def __init__(self, freq: np.ndarray, bits: int = SCALE_BITS):
        self.bits = bits
        self.freq = freq.astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        symbol = np.repeat(np.arange(len(freq)), freq)
        self.symbol = symbol.astype(np.uint32)
        self.slot_freq = freq[symbol].astype(np.uint32)
        self.slot_off = (np.arange(len(symbol)) - np.repeat(np.cumsum(freq) - freq, freq)).astype(np.uint32)
        self.fill = int(np.argmax(freq)) if len(freq) else 0


_5, _32 = np.uint64(5), np.uint64(32)


def encode_blocks(ids: list[np.ndarray], t: Tables) -> list[bytes]:
    """Payloads of blocks, all coded side by side; each is filled up with the
    commonest id to whole steps of all lanes."""
    g = len(ids)
    steps = max(-(-len(x) // LANES) for x in ids)
    sym = np.full((g, steps * LANES), t.fill, np.int64)
    for i, x in enumerate(ids):
        sym[i, :len(x)] = x
    sym = np.ascontiguousarray(sym.reshape(g, steps, LANES).transpose(1, 0, 2))
    per = SEGMENT // LANES
    state = np.full((g, LANES), 1 << 31, np.uint64)
    words = np.empty((steps, g, LANES), np.uint32)
    spilt = np.empty((steps, g, LANES), bool)
    points = np.empty((-(-steps // per), g, LANES), np.uint64)
    shift, room = np.uint64(t.bits), np.uint64(63 - t.bits)
    for k in range(steps - 1, -1, -1):
        s = sym[k]
        f = t.freq[s]
        full = state >= f << room
        spilt[k], words[k] = full, state  # the low word
        state = state >> (full.astype(np.uint64) << _5)
        high = state // f
        state = (high << shift) + (state - high * f) + t.cum[s]
        if k % per == 0:
            points[k // per] = state
    out = []
    at = np.concatenate([np.zeros((1, g), np.int64), np.cumsum(spilt.sum(2), axis=0)])
    for i, x in enumerate(ids):
        own = -(-len(x) // SEGMENT)
        w = words[:, i][spilt[:, i]]
        if steps > (mine := -(-len(x) // LANES)):  # fill steps behind its end: none of its words is there
            w = w[:at[mine, i]]
            # states at its end are not the start state; the last segment is coded to whole steps
        head = b"".join(np.uint32(at[k * per, i]).tobytes() + points[k, i].tobytes() for k in range(own))
        body = (MAGIC + np.array([LANES, SEGMENT], "<u2").tobytes()
                + np.array([len(x), len(w), zlib.crc32(x.astype("<u4").tobytes())], "<u4").tobytes() + head
                + w.astype("<u4").tobytes())
        out.append(body + np.uint32(zlib.crc32(body)).tobytes())
    return out


def decode_blocks(payloads: list[bytes], t: Tables) -> list[np.ndarray]:
    """Ids of blocks; all segments of all blocks are decoded side by side."""
    parts, base, states, starts, sizes, sums = [], 0, [], [], [], []
    for p in payloads:
        if p[:4] != MAGIC or zlib.crc32(p[:-4]) != int.from_bytes(p[-4:], "little"):
            raise ValueError("damaged block: its payload doesn't match its checksum")
        lanes, segment = np.frombuffer(p, "<u2", 2, 4)
        n, n_words, crc = (int(v) for v in np.frombuffer(p, "<u4", 3, 8))
        if (lanes, segment) != (LANES, SEGMENT):
            raise ValueError(f"block with {lanes} lanes and segments of {segment}")
        k = -(-n // SEGMENT)
        heads = np.frombuffer(p, np.dtype([("at", "<u4"), ("state", "<u8", LANES)]), k, 20)
        starts.append(heads["at"].astype(np.int64) + base)
        states.append(heads["state"])
        parts.append(np.frombuffer(p, "<u4", n_words, 20 + heads.nbytes))
        base += n_words
        sizes.append(n)
        sums.append(crc)
    words = np.concatenate([np.zeros(1, np.uint32), *parts]).astype(np.uint64)  # word k is at k + 1
    state, at = np.concatenate(states).astype(np.uint64), np.concatenate(starts)
    left = np.concatenate([np.minimum(SEGMENT, n - SEGMENT * np.arange(-(-n // SEGMENT))) for n in sizes])
    steps = -(-left // LANES)
    order = np.argsort(-steps, kind="stable")  # the segments still running are always the first ones
    state, at, live = state[order], at[order], steps[order]
    out = np.zeros((len(order), SEGMENT), np.uint32)
    mask, shift, low = np.uint64((1 << t.bits) - 1), np.uint64(t.bits), np.uint64(1 << 31)
    n = len(order)
    for k in range(SEGMENT // LANES):
        while n and live[n - 1] <= k:
            n -= 1
        if not n:
            break
        x = state[:n]
        slot = (x & mask).astype(np.int64)
        out[:n, k * LANES:(k + 1) * LANES] = t.symbol[slot]
        x = t.slot_freq[slot] * (x >> shift) + t.slot_off[slot]
        need = x < low
        upto = np.cumsum(need, axis=1)
        state[:n] = np.where(need, (x << _32) | words[at[:n, None] + upto], x)
        at[:n] += upto[:, -1]
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    result, k = [], 0
    for n, crc in zip(sizes, sums, strict=True):
        own = -(-n // SEGMENT)
        x = out[back[k:k + own]].reshape(-1)[:n]
        k += own
        if zlib.crc32(np.ascontiguousarray(x, "<u4").tobytes()) != crc:
            raise ValueError("damaged block: its ids don't match their checksum")
        result.append(x)
    return result


# ------------------------------------------------------------- writing

def tokenized(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens (end id included) and ids (unsigned 16-bit)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        tk = word_tokenizer(tokenizer)
        end = np.uint16(end_id).tobytes()
        for batch in batches_of(batches):
            ids = [tk.encode(x) + end for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, TOKENS)


def id_counts(tokens: DataFrame) -> DataFrame:
    """id, n over the whole table: one partial count per task and id."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counts = np.zeros(1 << 16, np.int64)
        for batch in batches_of(batches):
            ids = b"".join(batch.column(0).to_pylist())
            counts += np.bincount(np.frombuffer(ids, np.uint16), minlength=1 << 16)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used], pa.int64())], ["id", "n"])

    return tokens.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_files(spark: SparkSession, docs: DataFrame, path: str, tokenizer: str, end_id: int = 2,
                id_col: str = "doc_id", text_col: str = "text", group: int = 64) -> None:
    """Write ``path``/blocks and ``path``/frequencies. Two passes: tokenize and
    count, then range-partition the ids by document and code them. The counts
    that reach the driver are one row per id of the vocabulary (65,536 at
    most)."""
    tokenized(docs, tokenizer, end_id, id_col, text_col).write.option("compression", "zstd").parquet(f"{path}/ids")
    tokens = spark.read.parquet(f"{path}/ids")
    counts = np.zeros(1 << 16, np.int64)
    for r in id_counts(tokens).collect():
        counts[r["id"]] = r["n"]
    freq = scaled_frequencies(counts)
    spark.createDataFrame([(int(i), int(freq[i])) for i in np.flatnonzero(freq)], "id int, freq int") \
        .coalesce(1).write.parquet(f"{path}/frequencies")
    key, packed = path, freq.astype("<u4").tobytes()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        t = worker_cache(("rans", key), lambda: Tables(np.frombuffer(packed, "<u4").astype(np.int64)))
        part, first = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []  # ids not yet in a block
        n_held = 0
        docs: list[tuple] = []  # of the open block: doc_id or None, where its ids begin and end, its own tokens
        ready: list[tuple] = []

        def flush() -> pa.RecordBatch:
            payloads = encode_blocks([r[2] for r in ready], t)
            out = pa.RecordBatch.from_arrays(
                [pa.array([part] * len(ready), pa.int32()), pa.array([r[0] for r in ready], pa.int64()),
                 pa.array([len(r[2]) for r in ready], pa.int64()), pa.array([r[1] for r in ready], pa.binary()),
                 pa.array(payloads, pa.binary())], ["part", "first", "n_ids", "docs", "payload"])
            ready.clear()
            return out

        def close() -> None:
            nonlocal first, n_held
            index = np.array(docs, "<i8").tobytes()
            block = np.concatenate(held)
            ready.append((first, index, block))
            first += len(block)
            held.clear()
            docs.clear()
            n_held = 0

        for batch in batches_of(batches):
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(ids.as_buffer(), np.uint16)
                done = 0
                while done < len(x):
                    take = min(BLOCK - n_held, len(x) - done)
                    # doc_id, is null, offset in the block, ids here, ids before, ids of the document
                    docs.append((doc_id or 0, doc_id is None, n_held, take, done, len(x)))
                    held.append(x[done:done + take])
                    done += take
                    n_held += take
                    if n_held == BLOCK:
                        close()
                        if len(ready) == group:
                            yield flush()
        if n_held:
            close()
        if ready:
            yield flush()

    parts = n_tasks(spark, estimated_bytes(tokens))
    tie = F.xxhash64("ids")  # not the ids: a range partitioning samples its keys to the driver
    tokens.repartitionByRange(parts, F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie, F.col("ids")) \
        .select("doc_id", "ids").mapInArrow(run, BLOCKS) \
        .write.option("compression", "none").parquet(f"{path}/blocks")


# ------------------------------------------------------------- reading

def read_frequencies(spark: SparkSession, path: str) -> np.ndarray:
    freq = np.zeros(1 << 16, np.int64)
    for r in spark.read.parquet(f"{path}/frequencies").collect():
        freq[r["id"]] = r["freq"]
    return freq


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Decode the files: one row per document with doc_id, start, n_tokens,
    ids_crc32. A document over several blocks is put together by XOR of its
    pieces' shifted CRC-32, a sum with map-side combining. ``with_ids`` gives
    the pieces themselves (start, ids as unsigned 32-bit) instead."""
    packed, key = read_frequencies(spark, path).astype("<u4").tobytes(), path

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        t = worker_cache(("rans", key), lambda: Tables(np.frombuffer(packed, "<u4").astype(np.int64)))
        ops = worker_cache(("crc32",), crc32_zero_operators)
        for batch in batches_of(batches, 8 << 20):
            blocks = decode_blocks(batch.column("payload").to_pylist(), t)
            rows: list[tuple] = []
            for part, first, index, ids in zip(batch.column("part").to_pylist(), batch.column("first").to_pylist(),
                                               batch.column("docs").to_pylist(), blocks, strict=True):
                wide = ids.astype("<u4")
                raw = memoryview(wide).cast("B")
                for doc_id, null, at, n, before, total in np.frombuffer(index, "<i8").reshape(-1, 6).tolist():
                    crc = zlib.crc32(raw[4 * at:4 * (at + n)])
                    if behind := total - before - n:
                        crc = crc32_shift(crc, 4 * behind, ops)
                    rows.append((part, None if null else doc_id, first + at - before, n, crc,
                                 raw[4 * at:4 * (at + n)].tobytes() if with_ids else None, before))
            cols = list(zip(*rows, strict=True))
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types, strict=True)],
                                             ["part", "doc_id", "at", "n", "crc", "ids", "before"])

    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    # one row per file: ids in all files before it
    sizes = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    pieces = blocks.mapInArrow(run, "part int, doc_id long, at long, n long, crc long, ids binary, before long") \
        .join(F.broadcast(before), "part").withColumn("start", F.col("at") + F.col("offset"))
    if with_ids:
        return pieces.select("doc_id", "start", F.col("before").alias("piece_start"), "ids")
    return pieces.groupBy("doc_id", "start").agg(F.sum("n").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"))


def encode_corpus(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 2) -> tuple[str, DataFrame]:
    """Write ``docs`` below the shared folder; the path and the documents read
    back from the files."""
    path = shared_path(spark, "rans")
    write_files(spark, docs, path, tokenizer, end_id)
    return path, read_documents(spark, path)
