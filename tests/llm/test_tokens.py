"""Tokenizer cache, rANS files and online packing against brute force."""

import zlib

import numpy as np
import pytest

from newsweave.llm import online_packing as op
from newsweave.llm import rans_output as ro
from newsweave.llm.common import WordTokenizer, crc32_shift, crc32_zero_operators
from newsweave.llm.queries import vocabulary_path

from .conftest import ODD_TEXTS


def plain_ids(texts):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(vocabulary_path())
    return [tk.encode(t or "", add_special_tokens=False).ids for t in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_word_ids_are_whole_text_ids(documents):
    texts = [r["text"] for r in documents.collect()] + ODD_TEXTS + [
        "a'b a<|endoftext|> a<| ab.%%% AB&&& a_b _ab ab_ ÿŸ aß, İ Σς ﬁ é 1x2 q\xadq \xad"]
    tk = WordTokenizer(vocabulary_path(), limit=500)
    assert [np.frombuffer(tk.encode(t), np.uint16).tolist() for t in texts] == plain_ids(texts)


def test_crc_shift():
    ops = crc32_zero_operators()
    for n in (0, 1, 5, 4096, 100_003):
        a, b = b"some bytes", bytes(range(256)) * (n // 256) + b"q" * (n % 256)
        assert crc32_shift(zlib.crc32(a), len(b), ops) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_rans_round_trip():
    rng = np.random.default_rng(3)
    ids = rng.zipf(1.3, 300_000)
    ids = ids[ids < 40_000].astype(np.uint16)
    t = ro.Tables(ro.scaled_frequencies(np.bincount(ids, minlength=65536)))
    blocks = [ids[:65536], ids[65536:73728], ids[:1], ids[:31], ids[:8193], ids[100_000:150_000]]
    payloads = ro.encode_blocks(blocks, t)
    for a, b in zip(blocks, ro.decode_blocks(payloads, t), strict=True):
        assert (a == b).all() and len(a) == len(b)
    assert (ro.decode_blocks(payloads[3:4], t)[0] == blocks[3]).all()
    with pytest.raises(ValueError, match="checksum"):
        bad = bytearray(payloads[0])
        bad[1000] ^= 1
        ro.decode_blocks([bytes(bad)], t)


def test_frequencies_keep_every_id():
    c = np.zeros(65536, np.int64)
    c[:49_000] = 1
    c[7] = 10**12
    f = ro.scaled_frequencies(c)
    assert f.sum() == 1 << ro.SCALE_BITS and (f[c > 0] > 0).all() and not f[c == 0].any()
    assert not ro.scaled_frequencies(np.zeros(10, np.int64)).any()


def rans_expected(rows):
    ids = plain_ids([t for _, t in rows])
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0,
                                                    np.array(ids[i] + [2], np.uint16).tobytes()))
    out, start = [], 0
    for i in order:
        x = ids[i] + [2]
        out.append((rows[i][0], start, len(x), crc(x)))
        start += len(x)
    return out


@pytest.mark.parametrize("table", ["documents", "odd_docs"])
def test_rans_files(spark, table, request):
    docs = request.getfixturevalue(table)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    path, got = ro.encode_corpus(spark, docs, vocabulary_path())
    cols = ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.select(cols).collect()), key=lambda r: r[1]) == rans_expected(rows)
    back = {}
    for r in ro.read_documents(spark, path, with_ids=True).orderBy("start", "piece_start").collect():
        back.setdefault(r["start"], []).extend(np.frombuffer(r["ids"], "<u4").tolist())
    assert [crc(v) for _, v in sorted(back.items())] == [r[3] for r in rans_expected(rows)]


def test_rans_long_document_spans_blocks(spark):
    docs = spark.createDataFrame([(1, "alpha beta, gamma. " * 40_000), (2, "b")], "doc_id long, text string")
    got = ro.encode_corpus(spark, docs, vocabulary_path())[1].select("doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == rans_expected([(r[0], r[1]) for r in docs.collect()])


def check_packing(docs, pieces, window):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = sorted((crc(x + [1]), len(x) + 1) for x in plain_ids([t for _, t in rows]))
    by_doc, by_seq = {}, {}
    for r in pieces:
        raw = np.frombuffer(r["ids"], np.uint16)
        assert len(raw) == r["length"] and crc(raw.tolist()) == r["ids_crc32"]
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["padded"]))
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], raw))
    pad = 0
    for parts in by_seq.values():
        at = 0
        for offset, n, _ in sorted(parts):
            assert offset == at
            at += n
        assert at <= window and {p[2] for p in parts} == {op.padded_length(at, window)}
        pad += parts[0][2] - at
    return want, by_doc, pad


def test_packing(spark, documents):
    pieces = op.pack(documents, vocabulary_path(), with_ids=True, open_windows=8).collect()
    want, by_doc, pad = check_packing(documents, pieces, 2048)
    got = []
    for (_, total), parts in by_doc.items():
        ids = np.concatenate([x for _, x in sorted(parts, key=lambda p: p[0])])
        assert len(ids) == total
        got.append((crc(ids.tolist()), total))
    assert sorted(got) == want
    assert pad < 0.02 * sum(n for _, n in want)


def test_packing_odd_rows(spark, odd_docs):
    pieces = op.pack(odd_docs, vocabulary_path(), with_ids=True).collect()
    want, _, _ = check_packing(odd_docs, pieces, 2048)
    assert sum(r["length"] for r in pieces) == sum(n for _, n in want)


def test_empty_tables(spark, documents):
    none = documents.limit(0)
    assert op.pack(none, vocabulary_path()).count() == 0
    assert ro.encode_corpus(spark, none, vocabulary_path())[1].count() == 0
