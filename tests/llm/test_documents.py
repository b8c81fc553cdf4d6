"""Sharding, mixing, language ID, deduplication, n-gram join and quality
rules against brute force on small tables."""

import hashlib
import heapq
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsweave.llm import (centroid_langid, components, hash_mix, line_rules, lpt_shards, stream_dedup, trie_join,
                           url_rules)
from newsweave.llm.common import shared_path
from newsweave.llm.queries import URL_RULES

from .conftest import SF

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(t):
    return [w for w in SPACE.split(t or "") if w]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


@pytest.fixture(params=["documents", "odd_docs"])
def table(request):
    return request.getfixturevalue(request.param)


# ---------------------------------------------------------------- sharding

def plain_lpt(sizes, k):
    heap = [(0, s) for s in range(k)]
    for x in sorted(sizes, reverse=True):
        load, s = heapq.heappop(heap)
        heapq.heappush(heap, (load + x, s))
    return sorted(load for load, _ in heap)


@pytest.mark.parametrize("sizes", [[7] * 1000, [1000, 5, 5, 3] + [2] * 700 + [1] * 333, list(range(1, 500)) * 3, [10**9, 1]])
def test_lpt_histogram_is_lpt(sizes):
    classes = sorted(Counter(sizes).items(), reverse=True)
    given = lpt_shards.lpt(classes, 16)
    loads = [sum(s * g[i] for (s, _), g in zip(classes, given, strict=True)) for i in range(16)]
    assert all(sum(g) == n for (_, n), g in zip(classes, given, strict=True))
    assert sorted(loads) == plain_lpt(sizes, 16)


def test_shards(table):
    rows = lpt_shards.assign(table, 16).collect()
    texts = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode()))
                    for r in table.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == texts
    by_text, slots, load, groups = defaultdict(set), defaultdict(list), Counter(), Counter()
    for r in rows:
        by_text[r["text_crc32"], r["size"]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
        groups[r["text_crc32"], r["size"]] += r["size"]
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 16
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    best = plain_lpt(groups.values(), 16)
    assert max(load.values()) <= 1.01 * best[-1] + 1


# ------------------------------------------------------------------ mixing

def plain_targets(sizes, weights=(5, 2, 1), ratio=1.5):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), ratio * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        share = sum(weight[s] for s in open_)
        given = {s: left * weight[s] / share for s in open_}
        left = 0.0
        for s, x in given.items():
            target[s] += x
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


def test_mix(table):
    rows = hash_mix.mix(table).collect()
    sizes, biggest, taken = Counter(), Counter(), Counter()
    for r in table.collect():
        sizes[r["source"]] += len(words(r["text"]))
        biggest[r["source"]] = max(biggest[r["source"]], len(words(r["text"])))
    want = plain_targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-9, abs_tol=1e-6)
        assert r["size"] == 0 and r["taken"] == 0 or r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
    assert len(rows) == table.count()
    # half a document is the most that a source misses
    for s in want:
        assert abs(taken[s] - want[s]) <= biggest[s] / 2 + 1e-6
    mixed = hash_mix.apply_mix(table)
    assert mixed.columns == table.columns
    assert sum(len(words(r["text"])) for r in mixed.select("text").collect()) == sum(taken.values())


def test_mix_of_equal_rows(spark):
    """A source of rows equal in id and text meets its target all the same, in
    the mix and in its rows."""
    rows = [(1, "a b c d", "s0", "x")] * 1000 + [(None, "e f", "s1", "y")] * 999 + [(k, "g h i", "s2", "z") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n string")
    for ratio in (0.3, 0.7, 1.5):
        got = hash_mix.mix(docs, ratio=ratio).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g")).collect()
        assert all(abs(r["t"] - r["g"]) <= 2 for r in got) and len(got) == 3
        mixed = hash_mix.apply_mix(docs, ratio=ratio)
        n = {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()}
        assert n == {r["source"]: r["t"] for r in got if r["t"]}


def test_mix_is_nested(documents):
    got = []
    for ratio in (0.4, 0.7, 1.0):
        got.append({r["doc_id"] for r in hash_mix.mix(documents, ratio=ratio).where("taken > 0").collect()})
    assert got[0] < got[1] <= got[2]


# ------------------------------------------------------------- language ID

def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = centroid_langid.fit(docs, ~centroid_langid.held_out(), fit_rows=200)
    rows = centroid_langid.predict(docs.withColumn("held_out", centroid_langid.held_out()), model).collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 150 and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["rejected"] for r in rows]) < 0.02


def test_language_odd_rows(spark, odd_docs, documents):
    model = centroid_langid.fit(documents, F.lit(True))
    extra = spark.createDataFrame([(100, "0123 4567 !!", None, None, 1, ""), (101, "@@@@ 漢字漢字", None, None, 1, "")],
                                  odd_docs.schema)
    rows = centroid_langid.predict(odd_docs.unionByName(extra), model).collect()
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters)
        assert letters or (r["rejected"] and r["score"] == 0)
    assert {r["doc_id"]: r["rejected"] for r in rows}[101]
    none = centroid_langid.predict(documents, centroid_langid.fit(documents.limit(0), F.lit(True)))
    assert {r["lang_pred"] for r in none.select("lang_pred").distinct().collect()} == {"und"}


# ----------------------------------------------------------- deduplication

def test_language_idf_counts_all_texts(spark):
    """A small sample for the centroids, all training texts for the idf."""
    texts = ["the cat", "a dog ran", "le chat", "un chien", "", None]
    rows = [(i, texts[i % 6], "en" if i % 6 < 2 else "fr") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = centroid_langid.fit(docs, F.lit(True), fit_rows=20)
    seen = sum((centroid_langid.counts_of(t)[0] > 0).astype(float) for _, t, _ in rows if t)
    assert np.allclose(model.idf, np.log(401 / (1 + seen)) + 1, atol=1e-5)


def test_language_sample_without_ids(spark, monkeypatch):
    """Rows of one id, or without any, are neither all taken nor all left out."""
    taken = []
    features = centroid_langid.features
    monkeypatch.setattr(centroid_langid, "features",
                        lambda docs, *a: taken.append(docs.count()) or features(docs, *a))
    for i in (None, 5):
        docs = spark.createDataFrame([(i, f"word {chr(97 + k % 26)}{chr(97 + k // 26)}", "en") for k in range(600)],
                                     "doc_id long, text string, lang string")
        centroid_langid.fit(docs, F.lit(True), fit_rows=60)
    assert all(25 < n < 110 for n in taken) and len(taken) == 2


def saved(df):
    path = shared_path(df.sparkSession, "test")
    df.repartition(3).write.parquet(path)
    return path


def plain_groups(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[SPACE.sub(" ", t or "")].append(i)
    out = []
    for t, ids in by.items():
        keep = min(ids, key=lambda i: (i is None, i or 0))
        out += [(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


@pytest.mark.parametrize("weak", [False, True])
def test_stream_dedup(spark, table, weak):
    digest = (lambda t: F.unhex(F.lpad(F.hex(F.length(t) % 3), 2, "0"))) if weak else stream_dedup.sha256
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    got = stream_dedup.deduplicate(spark, saved(table), digest=digest).collect()
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got], key=repr) == \
        plain_groups(rows)
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len({r["text_sha256"] for r in got})
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_stream_dedup_later_files(spark, documents):
    path, state = shared_path(spark, "test"), shared_path(spark, "state")
    documents.where("doc_id >= 100").write.parquet(path)
    stream_dedup.deduplicate(spark, path, state=state)
    documents.where("doc_id < 100").write.mode("append").parquet(path)
    got = stream_dedup.deduplicate(spark, path, state=state).collect()
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got], key=repr) == \
        plain_groups([(r["doc_id"], r["text"]) for r in documents.collect()])


# ------------------------------------------------------------ n-gram join

def plain_sets(rows, n=4):
    out = []
    for _, t in rows:
        w = lower(t or "").encode().split()
        out.append({tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    return out


def plain_components(rows, percent=85, n=4):
    sets = plain_sets(rows, n)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            by[x].add(i)
    for i, s in enumerate(sets):
        for j, k in Counter(j for x in s for j in by[x] if j > i).items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                root[find(j)] = find(i)
    ids = defaultdict(list)
    for i in range(len(rows)):
        ids[find(i)].append(rows[i][0])
    least = {r: min(v, key=lambda i: (i is None, i or 0)) for r, v in ids.items()}
    return sorted([(rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows))], key=repr)


def joined(docs, **kw):
    return sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in
                   trie_join.similar(docs, **kw).collect()], key=repr)


def test_trie_join_brute(spark, table):
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    assert joined(table) == plain_components(rows)


def test_trie_join_near_copies(spark):
    rng = np.random.default_rng(5)
    rows, vocabulary = [], [f"w{i}" for i in range(300)]
    for g in range(8):  # groups of copies with a few words changed each, chains among them
        base = list(rng.choice(vocabulary, int(rng.integers(4, 160))))
        for _ in range(12):
            base = list(base)
            for _ in range(int(rng.integers(0, 4))):
                base[int(rng.integers(len(base)))] = str(rng.choice(vocabulary))
            rows.append((len(rows), " ".join(base)))
    rows += [(1000 + i, t) for i, t in enumerate(["one", "ONE", "one two", "one two three", None, "", "a b c d", "A B C D"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert joined(docs) == plain_components(rows)
    assert joined(docs, n=2, percent=60) == plain_components(rows, 60, 2)


def test_trie_join_hot_passages(spark):
    """Passages that many documents quote, near copies beyond the limit of
    cold keys, and chains across both."""
    rng = np.random.default_rng(9)
    words_ = [f"w{i}" for i in range(4000)]
    passages = [list(rng.choice(words_, 40)) for _ in range(3)]
    rows = []
    for i in range(60):  # a passage and own words, from hardly any to many
        own = list(rng.choice(words_, int(rng.integers(0, 200))))
        rows.append(passages[i % 3] + own)
    base = list(rng.choice(words_, 120))
    for _ in range(40):  # one large group of near copies, a few of them further off
        x = list(base)
        for _ in range(int(rng.integers(0, 5))):
            x[int(rng.integers(len(x)))] = str(rng.choice(words_))
        rows.append(x + (passages[0] if rng.random() < 0.2 else []))
    for _ in range(20):  # containment: a document and the same with up to a fifth more
        x = list(rng.choice(words_, 100))
        rows += [x, x + list(rng.choice(words_, int(rng.integers(1, 22))))]
    docs = [(i, " ".join(map(str, r))) for i, r in enumerate(rows)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert joined(df) == plain_components(docs)


def plain_links(rows, percent=85, n=4):
    """Of each row's set, how many different ones link with it."""
    sets = [frozenset(s) for s in plain_sets(rows, n)]
    count = Counter()
    kinds = [s for s in set(sets) if s]
    for i, a in enumerate(kinds):
        for b in kinds[:i]:
            if 100 * len(a & b) >= percent * len(a | b):
                count.update((a, b))
    return sorted((r[0], count[s]) for r, s in zip(rows, sets, strict=True))


@pytest.mark.parametrize(("block", "cold"), [(trie_join.BLOCK, trie_join.COLD), (4, 16), (trie_join.BLOCK, 1), (3, 1), (512, 10**6)])
def test_trie_join_counts_all_links(spark, monkeypatch, block, cold):
    """Links inside a component too: a chain A-B-C whose ends also link, a
    large group of near copies and a passage that many quote; all keys hot, or all cold."""
    monkeypatch.setattr(trie_join, "BLOCK", block)
    rng = np.random.default_rng(12)
    vocabulary = [f"w{i}" for i in range(3000)]
    base, chain = (list(rng.choice(vocabulary, 150)) for _ in range(2))
    rows = [chain, chain + ["x1"], chain + ["x1", "x2"], chain, [], ["one"]]
    for _ in range(40):
        x = list(base)
        for _ in range(int(rng.integers(0, 4))):
            x[int(rng.integers(len(x)))] = str(rng.choice(vocabulary))
        rows.append(x)
    rows += [base[:60] + list(rng.choice(vocabulary, int(rng.integers(5, 80)))) for _ in range(30)]
    docs = [(i, " ".join(map(str, r))) for i, r in enumerate(rows)]
    got = trie_join.similar(spark.createDataFrame(docs, "doc_id long, text string"), cold=cold).collect()
    want = plain_links(docs)
    assert want[:6] == [(0, 2), (1, 2), (2, 2), (3, 2), (4, 0), (5, 0)] and max(n for _, n in want) > 15
    assert sorted((r["doc_id"], r["n_links"]) for r in got) == want
    assert sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got], key=repr) == plain_components(docs)


def test_trie_join_without_ids(spark):
    """2,000 near copies without ids, and as many with one id: rows in
    proportion, not their square, with whole texts."""
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(120)]
    rows = [(None if k % 2 else 7, " ".join([*base[:int(rng.integers(100))], f"n{k}", *base])) for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = trie_join.similar(docs)
    assert out.count() == 4000
    few = rows[:300]
    assert joined(spark.createDataFrame(few, "doc_id long, text string")) == plain_components(few)


def test_block_join():
    rng = np.random.default_rng(16)
    for _ in range(40):
        pool = np.arange(50, dtype=np.uint64)
        pick = lambda: np.sort(rng.choice(pool, int(rng.integers(1, 40)), replace=False))
        probes, sets = [pick() for _ in range(15)], [pick() for _ in range(25)]
        sets += [probes[0], probes[3], sets[0]]
        got = trie_join.block_join(probes, sets, 60)
        assert got.tolist() == [[trie_join.linked(len(np.intersect1d(p, s)), len(s), len(p), 60) for s in sets] for p in probes]


def test_tree_join():
    rng = np.random.default_rng(6)
    for _ in range(60):
        pool = np.arange(40, dtype=np.uint64)
        pick = lambda: np.sort(rng.choice(pool, int(rng.integers(1, 30)), replace=False))
        probe, sets = pick(), [pick() for _ in range(30)]
        sets += [probe, sets[0]]
        want = [i for i, s in enumerate(sets) if trie_join.linked(len(np.intersect1d(s, probe)), len(s), len(probe), 60)]
        assert sorted(trie_join.tree_join(probe, sets, 60)) == want
        cut = lambda x: x[:trie_join.prefix_length(len(x), 60)]
        maybe = trie_join.tree_join(cut(probe), [cut(s) for s in sets], 60, len(probe), [len(s) for s in sets])
        assert set(want) <= set(maybe)
        cut = lambda x: x[:max(1, len(x) // 2)]
        assert set(want) <= set(trie_join.tree_join(cut(probe), [cut(s) for s in sets], 60, len(probe),
                                                    [len(s) for s in sets]))


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(200, 260)] + [(500, 499), (499, 500), (7, 7)]
    got = components.components(spark.createDataFrame(links, "a long, b long"))
    root = {r["node"]: r["root"] for r in got.collect()}
    assert {root[i] for i in range(41)} == {0} and {root[i] for i in [100, *range(200, 260)]} == {100}
    assert root[500] == 499 and got.count() == len(root)


# ------------------------------------------------------------ quality rules

def plain_measures(t):
    t = t or ""
    w = words(t)
    spots = defaultdict(list)
    for i in range(len(w) - 2):
        spots[tuple(w[i:i + 3])].append(i)
    covered = {i + k for s in spots.values() if len(s) > 1 for i in s for k in range(3)}
    lines = [x for x in t.split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))


def plain_quality(rows, min_docs, min_share, keep_share):
    norm = lambda x: " ".join(words(x.lower()))
    docs, hold = Counter(h for _, _, h in rows), Counter()
    for _, t, h in rows:
        hold.update({(h, norm(x)) for x in (t or "").split("\n") if words(x)})
    hot = {k for k, n in hold.items() if n > min_docs and n > min_share * docs[k[0]]}
    out = []
    for i, t, h in rows:
        m = plain_measures(t)
        failed = m[0] < 50 or 100 * m[4] > 50 * m[0]
        gone = sum(len(words(x)) for x in (t or "").split("\n") if words(x) and (h, norm(x)) in hot)
        out.append((i, *m, failed, not failed and m[0] - gone >= keep_share * m[0], gone))
    return sorted(out, key=repr)


def test_quality_of_small_hosts(spark):
    """Production limits: a host of 60 documents that all hold the same lines
    loses them, a passage of 50 words in 20 documents of a larger host goes,
    one in five documents stays."""
    rng = np.random.default_rng(3)
    text = lambda n: " ".join(f"w{x}" for x in rng.integers(10**6, size=n))
    menu, passage, few = text(60), text(50), text(50)
    rows = [(i, menu + "\n" + text(70), "small") for i in range(60)]
    rows += [(100 + i, text(80) + ("\n" + passage if i < 20 else "\n" + few if i < 25 else ""), "large") for i in range(300)]
    rows += [(500 + i, menu + "\n" + menu, "copies") for i in range(30)]
    got = {r["doc_id"]: r for r in line_rules.judge(
        spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i]["removed_words"] == 60 and got[i]["kept"] for i in range(60))
    assert [got[100 + i]["removed_words"] for i in range(300)] == [50] * 20 + [0] * 280
    assert not any(got[500 + i]["kept"] for i in range(30))


@pytest.mark.parametrize("limits", [(line_rules.MIN_DOCS, line_rules.MIN_SHARE, 0.5), (2, 0.0, 0.9)])
def test_quality(table, limits):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in table.collect()]
    got = line_rules.judge(table, *limits, with_text=True).collect()
    assert sorted([tuple(r)[:9] for r in got], key=repr) == plain_quality(rows, *limits)
    for r in got:
        assert (r["text"] is None and r["n_words"] == 0) or len(words(r["text"])) == r["n_words"] - r["removed_words"]


# -------------------------------------------------------------- URL filters

def plain_verdict(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = lower(re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_url_rules(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    odd = [None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "http://a.com?q=/en/",
           "http://ünï.net/es/", "http://net/es/", "http://xnet/es/", "http://x.net/ES/", "a://b://c.net/fr/1"]
    pages = pages.unionByName(spark.createDataFrame([(1000 + i, u) for i, u in enumerate(odd)], "page_id long, url string"))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = {r["page_id"]: r for r in url_rules.judge(pages, labels, URL_RULES).collect()}
    for r in pages.collect():
        host, path, rule, verdict = plain_verdict(r["url"])
        g = got[r["page_id"]]
        assert (g["host"], g["path"], g["rule"]) == (host, path, rule)
        assert g["verdict"] == verdict if rule else g["verdict"] in ("allow", "block")


def test_mined_url_rules(spark):
    rows, marks = [], []
    for i in range(400):  # bad: casino and bonus together
        t = ("casino" if i % 2 else "news", "bonus" if i % 3 == 0 else "daily")
        rows.append((i, f"https://www.site{i % 7}.org/{t[0]}/{t[1]}/{i}?id={i}"))
        if i % 5:
            marks.append((i, 1, int(t == ("casino", "bonus"))))
    pages = spark.createDataFrame(rows + [(900, None), (901, "x")], "page_id long, url string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    rules = url_rules.mine(pages, labels, 0.02, 0.9)
    found = {tuple(r["tokens"]) for r in rules.collect()}
    assert ("step:bonus", "step:casino") in found
    assert not any(set(a) < set(b) for a in found for b in found)
    got = {r["page_id"]: r["verdict"] for r in url_rules.judge(pages, labels, [], 0.02, 0.9).collect()}
    for i, u in rows:
        assert (got[i] == "block") == ("casino" in u and "bonus" in u)
    assert got[900] == got[901] == "allow"
    none = url_rules.judge(pages, labels.limit(0), [])
    assert none.where("verdict = 'allow'").count() == pages.count()


def test_mined_rule_of_five_tokens(spark):
    """Bad only with all of four steps and a query name; in fours half are good."""
    parts = ("a", "b", "c", "d", "q")

    def url(x):
        return "https://site.org/" + "/".join(p for p in x if p != "q") + ("?q=1" if "q" in x else "")

    four = [tuple(p for p in parts if p != gone) for gone in parts]
    rows = [(i, url(x), x == parts) for i, x in enumerate([parts] * 20 + four * 20)]
    pages = spark.createDataFrame([r[:2] for r in rows] + [(1000, url(parts) + "&z=2"), (1001, url(four[0]))],
                                  "page_id long, url string")
    labels = spark.createDataFrame([(i, 1, int(bad)) for i, _, bad in rows], "doc_id long, quality int, toxic int")
    rules = url_rules.mine(pages, labels)
    assert [tuple(r["tokens"]) for r in rules.collect()] == [("name:q", "step:a", "step:b", "step:c", "step:d")]
    got = {r["page_id"]: r["verdict"] for r in url_rules.judge(pages, labels, []).collect()}
    assert all((got[i] == "block") == bad for i, _, bad in rows)
    assert got[1000] == "block" and got[1001] == "allow"


def plain_blocked(known, urls, min_pages, confidence):
    """Urls with a set of tokens that enough bad pages hold, and most pages
    that hold it are bad; sets grow while enough bad pages are left."""
    def grows(tokens, start, held):
        for k in range(start, len(tokens)):
            now = [bad for bad in held if tokens[k] in bad[0]]
            bad = sum(b for _, b in now)
            if bad >= min_pages and (bad >= confidence * len(now) or grows(tokens, k + 1, now)):
                return True
        return False

    return {u for u, tokens in urls.items() if grows(sorted(tokens), 0, known)}


@pytest.mark.parametrize("limits", [(url_rules.MIN_SUPPORT, url_rules.MIN_CONFIDENCE, url_rules.MIN_PAGES), (0.01, 0.35, 2)])
def test_mined_verdicts_brute(spark, limits):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    share, confidence, least = limits
    rules = url_rules.mine(pages, labels, share, confidence, min_pages=least)
    got = {r["url"] for r in url_rules.blocked_urls(pages, rules).collect()}
    mark = {}
    for r in labels.collect():
        mark[r["doc_id"]] = mark.get(r["doc_id"], False) or r["toxic"] == 1 or r["quality"] == 0
    rows = pages.withColumn("t", url_rules.tokens_of(F.col("url"))).collect()
    known = [(frozenset(r["t"]), mark[r["page_id"]]) for r in rows if r["page_id"] in mark and r["t"]]
    urls = {r["url"]: r["t"] for r in rows if r["url"] is not None and r["t"]}
    least = max(least, math.ceil(share * len(known)))
    assert got == plain_blocked(known, urls, least, confidence) and 0 < len(known)


def test_long_repeated_urls(spark):
    """Bad and good pages of 30 tokens that come again and again: their tokens
    are a few items, and mining ends."""
    far = "/".join(f"step{chr(97 + k)}x" for k in range(26))
    rows = [(k, f"https://a.b.c.example.org/{far}/bad?x=1") for k in range(12)]
    rows += [(50 + k, f"https://a.b.c.example.org/{far}/good?x=1") for k in range(12)]
    rows += [(100 + k, f"https://site{chr(97 + k % 20)}.net/news/{k}") for k in range(90)]
    pages = spark.createDataFrame([*rows, (900, f"https://q.org/{far}"), (901, "https://z.org/bad")], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1, int(i < 12)) for i, _ in rows], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r["verdict"] for r in url_rules.judge(pages.withColumn("rule", F.lit("x")), labels, []).collect()}
    assert all((got[i] == "block") == (i < 12) for i, _ in rows)
    assert got[900] == "allow" and got[901] == "block"


# ---------------------------------------------------------------- no rows

def test_no_rows(spark, documents):
    none = documents.limit(0)
    assert lpt_shards.assign(none).count() == 0
    assert hash_mix.mix(none).count() == 0 and hash_mix.apply_mix(none).count() == 0
    assert centroid_langid.predict(none, None).count() == 0
    assert stream_dedup.deduplicate(spark, saved(none)).count() == 0
    assert trie_join.similar(none).count() == 0
    assert line_rules.judge(none).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_rules.judge(pages, spark.createDataFrame([], "doc_id long, quality int, toxic int"), URL_RULES).count() == 0
