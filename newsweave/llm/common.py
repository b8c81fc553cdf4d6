"""Helpers shared by the operators of this subpackage: reading tables, the
shared work folder, worker-wide caches, tokenizing and checksums."""

from __future__ import annotations

import math
import sys
import types
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

from ..session import batches_of, checkpoint, shared_path

#: White space of the word contract: blank, tab, LF, VT, FF, CR. ``bytes.split()``
#: splits on exactly these.
SPACES = " \t\n\x0b\x0c\r"
WORD_RE = r"[^\x20\x09-\x0D]+"
SPACE_RUN_RE = r"[\x20\x09-\x0D]+"

#: Bytes of input that one task of a keyed stage should read.
TASK_BYTES = 64 << 20


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` written to the shared checkpoint folder and read again: lineage
    ends there, and a lost executor costs no more than its running tasks."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.parquet(path)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores behind as keep it from
    clashing with a column of ``df``, case aside."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def n_tasks(spark: SparkSession, n_bytes: int = 0) -> int:
    """Tasks for a keyed stage: the session's number of shuffle partitions, or
    more if the input is larger than these hold at TASK_BYTES each."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_bytes / TASK_BYTES), 1)


def worker_cache(key: tuple, make: Callable):
    """One object per key and Python worker, shared by all tasks that the
    worker runs. The package travels by value, so its own globals are new in
    every task; ``sys.modules`` is not."""
    store = sys.modules.setdefault("_newsweave_worker_cache", types.ModuleType("_newsweave_worker_cache")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def release_worker_cache() -> None:
    """Give back what earlier jobs keep in this worker (a tokenizer's cache is
    some hundred MB), before a job that needs the room itself."""
    sys.modules.pop("_newsweave_worker_cache", None)


# ---------------------------------------------------------------- tokenizing

def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes each byte as one printable letter: printable
    Latin-1 stands for itself, all others take 256, 257, ... in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTokenizer(dict):
    """Ids of whole texts by a ``tokenizers`` file that drops white space; as a
    dict, the cache from word to its ids as bytes.

    Such a tokenizer never joins pieces over white space, so a text's ids are
    the ids of its words one after the other. Frequent words are answered from
    a cache of two generations with ``limit`` entries each. A missing word of
    plain Latin letters, marks behind it allowed, goes straight to the library's BPE model in the form
    that its normalizer and pre-tokenizer would hand over; every other word
    goes through the whole library pipeline. ``tests/llm`` compares both with
    ``encode`` of whole texts.
    """

    def __init__(self, path: str, code: str = "H", limit: int = 400_000):
        import json
        import re
        from array import array

        from tokenizers import Tokenizer

        super().__init__()
        self.array, self.code, self.limit = array, code, limit
        self.tokenizer = Tokenizer.from_file(path)
        kinds = json.loads(self.tokenizer.to_str())
        norm = [n["type"] for n in (kinds["normalizer"] or {}).get("normalizers", [])]
        if norm != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"{path}: not a lower-casing word tokenizer that drops white space")
        if max(self.tokenizer.get_vocab(with_added_tokens=True).values()) >= 256 ** array(code).itemsize:
            raise ValueError(f"items of type {code!r} can't hold the ids of {path}")
        self.pieces = self.tokenizer.model.tokenize
        self.pieces.__self__._resize_cache(0)  # this object's own cache serves better
        self.letters_only = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
        self.marks = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # no apostrophe: 's, 't and the like are pieces
        self.letters = _byte_letters()
        self.old: dict[bytes, bytes] = {}
        self.cores: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        hit = self.old.get(word)
        if hit is None:
            low = word.lower()
            core = low.rstrip(self.marks)
            hit = self.cores.get(core)
            if hit is None:
                hit = self._core(core)
            if not hit:  # not one run of letters
                hit = self._ids(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids)
            elif len(core) < len(low):
                hit += self._mark(low[len(core):])
        self[word] = hit
        return hit

    def _ids(self, ids: list[int]) -> bytes:
        return self.array(self.code, ids).tobytes()

    def _core(self, core: bytes) -> bytes:
        """Ids of a run of letters; empty if it is something else."""
        text, hit = core.decode("utf-8", "replace"), b""
        if self.letters_only(text):
            if not text.isascii():
                text = text.lower().encode().decode("latin-1").translate(self.letters)
            hit = self._ids([t.id for t in self.pieces(text)])
        if len(self.cores) > self.limit:
            self.cores.clear()
        self.cores[core] = hit
        return hit

    def _mark(self, mark: bytes) -> bytes:
        hit = self.cores.get(b" " + mark)
        if hit is None:
            hit = self.cores[b" " + mark] = self._ids([t.id for t in self.pieces(mark.decode())])
        return hit

    def encode(self, text: str | None) -> bytes:
        """Ids of one text in the machine's byte order, null as empty."""
        if not text:
            return b""
        words = text.encode("utf-8", "replace").split()
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()
        if len(words) <= 50_000:
            return b"".join(map(self.__getitem__, words))
        out = []
        for i in range(0, len(words), 50_000):
            out.append(b"".join(map(self.__getitem__, words[i:i + 50_000])))
            if len(self) > self.limit:
                self.old = dict(self)
                self.clear()
        return b"".join(out)


def word_tokenizer(path: str, code: str = "H") -> WordTokenizer:
    return worker_cache(("tokenizer", path, code), lambda: WordTokenizer(path, code))


# ----------------------------------------------------------------- checksums

def _gf2_times(matrix: list[int], vector: int) -> int:
    total, i = 0, 0
    while vector:
        if vector & 1:
            total ^= matrix[i]
        vector >>= 1
        i += 1
    return total


def crc32_zero_operators(bits: int = 48) -> list[list[int]]:
    """Matrix i advances a CRC-32 over 2**i zero bytes; matrices over GF(2) as
    the images of the 32 unit vectors."""
    one = [0xEDB88320] + [1 << i for i in range(31)]  # one zero bit
    ops, m = [], one
    for k in range(3 + bits):
        if k >= 3:
            ops.append(m)
        m = [_gf2_times(m, v) for v in m]
    return ops


def crc32_shift(crc: int, n_bytes: int, ops: list[list[int]]) -> int:
    """The share of a piece in the CRC-32 of a longer text: crc32(a + b) is
    ``crc32_shift(crc32(a), len(b)) ^ crc32(b)``. So a text's CRC is the XOR
    of its shifted pieces, in any order."""
    i = 0
    while n_bytes:
        if n_bytes & 1:
            crc = _gf2_times(ops[i], crc)
        n_bytes >>= 1
        i += 1
    return crc


# ------------------------------------------------------- vectors of tasks

PIECE = 1 << 15


def to_pieces(vector, dtype: str = "<f8", first: int = 0):
    """A task's vector as rows (piece, data), numbered from ``first``."""
    import pyarrow as pa

    cuts = range(0, len(vector), PIECE)
    return pa.RecordBatch.from_arrays(
        [pa.array(range(first, first + len(cuts)), pa.int32()),
         pa.array([vector[i:i + PIECE].astype(dtype).tobytes() for i in cuts], pa.binary())], ["piece", "data"])


def sum_pieces(pieces: DataFrame, sizes: list[tuple[int, str]]) -> list:
    """The sums of all tasks' vectors, given as (length, type); vector i has
    the piece numbers from ``i << 16``. Each piece is summed in a task of its
    own, in doubles; the driver gets one vector of each kind."""
    import numpy as np

    kinds = [kind for _, kind in sizes]

    def add(key, table):
        import pyarrow as pa

        kind = kinds[key[0].as_py() >> 16]
        total = np.zeros(len(table["data"][0].as_py()) // np.dtype(kind).itemsize)
        for x in table["data"].to_pylist():
            total += np.frombuffer(x, kind)
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([total.tobytes()], pa.binary())})

    out = [np.zeros(n) for n, _ in sizes]
    for r in pieces.groupBy("piece").applyInArrow(add, "piece int, data binary").collect():
        at = (r["piece"] & 0xFFFF) * PIECE
        out[r["piece"] >> 16][at:at + PIECE] = np.frombuffer(r["data"], "<f8")
    return out


__all__ = [
    "SPACES", "SPACE_RUN_RE", "WORD_RE", "WordTokenizer", "batches_of", "checkpoint", "crc32_shift",
    "crc32_zero_operators", "free_names", "load", "n_tasks", "release_worker_cache", "shared_path", "sum_pieces", "to_pieces",
    "word_tokenizer", "worker_cache", "written",
]
