"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 likelihood by a hidden Markov model."""
    from .hmm_lm import score_corpus

    return score_corpus(load(spark, sf_dir, "documents"))


def op2_rans_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document written as rANS files and read back."""
    from .rans_output import encode_corpus

    return encode_corpus(spark, load(spark, sf_dir, "documents"), vocabulary_path(), end_id=2)[1]


def op3_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes; equal texts stay
    together."""
    from .lpt_shards import assign

    return assign(load(spark, sf_dir, "documents"), 16)


def op4_hash_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by source weights 5, 2, 1 to 150 % of all words."""
    from .hash_mix import mix

    return mix(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op5_centroid_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those not held out."""
    from .centroid_langid import fit, held_out, predict

    docs = load(spark, sf_dir, "documents")
    model = fit(docs, ~held_out())
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")


def op6_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one of equal text that stays."""
    from .stream_dedup import deduplicate

    return deduplicate(spark, f"{sf_dir.rstrip('/')}/documents.parquet").drop("place")


def op7_trie_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the least id of its component of similar texts, and
    how many other classes of equal sets its own links with."""
    from .trie_join import similar

    return similar(load(spark, sf_dir, "documents"), n=4, percent=85)


#: The explicit rules of op8: verdict, host, path.
URL_RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
)


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    from .url_rules import judge

    return judge(load(spark, sf_dir, "pages"), load(spark, sf_dir, "labels"), URL_RULES)


def op9_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures, line frequency and the verdict on every document."""
    from .line_rules import judge

    return judge(load(spark, sf_dir, "documents"))


def op10_online_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids in sequences of at most 2048."""
    from .online_packing import pack

    return pack(load(spark, sf_dir, "documents"), vocabulary_path(), end_id=1)


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 100-byte strings that also start
    earlier."""
    from .suffix_dedup import remove

    out = remove(load(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


def op12_merkle_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf and proof in the manifest of its language and of
    all languages, checked against a third of changed texts."""
    from .merkle_rollup import verify

    return verify(load(spark, sf_dir, "documents"))


def op13_setm_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2,000 best collocations of 2 to 5 words."""
    from .setm_phrases import collocations

    return collocations(load(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_hmm_lm, op2_rans_output, op3_lpt_shards, op4_hash_mix, op5_centroid_langid, op6_stream_dedup, op7_trie_join,
    op8_url_rules,
    op9_line_rules, op10_online_packing, op11_suffix_dedup, op12_merkle_rollup, op13_setm_phrases)}
# ---------------------------------------------------------------------- SQL
# DuckDB SQL where SQL can express the operator. The others (models, tokenizer
# files, hash thresholds, packing, scheduling) are tested by brute force, round
# trips and held-out accuracy in tests/llm.

_WORDS = r"regexp_extract_all({x}, '[^\x20\x09-\x0D]+')"
_A_TO_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_OP6 = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)"""

_OP7 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(x=f"translate(coalesce(text, ''), {_A_TO_Z})")} AS l FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(l) = 0 THEN CAST([] AS VARCHAR[])
        WHEN len(l) < 4 THEN [array_to_string(l, ' ')]
        ELSE list_transform(range(1, len(l) - 2), lambda i: l[i] || ' ' || l[i + 1] || ' ' || l[i + 2] || ' ' || l[i + 3])
      END)) AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM s
          UNION SELECT r.a, k.b FROM reach r JOIN links k ON k.a = r.b),
classes AS (SELECT doc_id, g, CASE WHEN len(g) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY g) END AS class_id FROM s),
n AS (SELECT l.a AS doc_id, count(DISTINCT y.class_id) AS n_links FROM links l JOIN classes x ON x.doc_id = l.a
      JOIN classes y ON y.doc_id = l.b WHERE x.class_id <> y.class_id GROUP BY l.a)
SELECT s.doc_id, len(s.g) AS n_shingles, s.class_id, c.component_id, coalesce(n.n_links, 0) AS n_links
FROM classes s JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
LEFT JOIN n USING (doc_id)"""

_OP9 = rf"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, {_WORDS.format(x="text")} AS l, list_filter(string_split(text, chr(10)),
        lambda x: regexp_matches(x, '[^ 	-
]')) AS lines FROM t),
win AS (SELECT doc_id, i, l[i] || ' ' || l[i + 1] || ' ' || l[i + 2] AS x
        FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS n FROM win) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
m AS (SELECT doc_id, source, len(l) AS n_words, CAST(coalesce(list_sum(list_transform(l, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, lines
      FROM w LEFT JOIN covered c USING (doc_id)),
li AS (SELECT doc_id, source, trim(regexp_replace(lower(x), '[ 	-
]+', ' ', 'g')) AS line, len({_WORDS.format(x="x")}) AS words
       FROM (SELECT doc_id, source, unnest(lines) AS x FROM m)),
hosts AS (SELECT source, count(*) AS docs FROM t GROUP BY source),
hot AS (SELECT source, line FROM li JOIN hosts h USING (source) GROUP BY source, line, h.docs
        HAVING count(DISTINCT doc_id) > 5 AND count(DISTINCT doc_id) > h.docs * 0.005),
gone AS (SELECT doc_id, CAST(sum(words) AS BIGINT) AS n FROM li JOIN hot USING (source, line) GROUP BY doc_id),
j AS (SELECT m.*, coalesce(g.n, 0) AS removed_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
      FROM m LEFT JOIN gone g USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words - removed_words >= n_words * 0.5 AS kept, removed_words FROM j"""


_OP11 = """
WITH t AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id NULLS FIRST) AS k, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT k, i, md5_number(substr(x, 2 * i + 1, 200)) AS h
      FROM (SELECT k, x, unnest(range(0, len(x) // 2 - 99)) AS i FROM t)),
later AS (SELECT k, i FROM (SELECT k, i, row_number() OVER (PARTITION BY h ORDER BY k, i) AS n FROM w) WHERE n > 1),
edges AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY k ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM later),
runs AS (SELECT k, min(i) AS a, max(i) + 100 AS b
         FROM (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY i) AS g FROM edges) GROUP BY k, g),
gaps AS (SELECT k, b AS a, lead(a) OVER (PARTITION BY k ORDER BY a, b) AS b FROM (SELECT k, a, b FROM runs UNION ALL SELECT k, 0, 0 FROM t)),
kept AS (SELECT k, string_agg(substr(x, 2 * a + 1, CASE WHEN b IS NULL THEN len(x) ELSE 2 * (b - a) END), '' ORDER BY a) AS x
         FROM gaps JOIN t USING (k) GROUP BY k),
n AS (SELECT k, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM runs GROUP BY k)
SELECT doc_id, CAST(len(t.x) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(kept.x)) AS kept_sha256
FROM t JOIN kept USING (k) LEFT JOIN n USING (k)"""


def _op12(levels: int = 7, group_levels: int = 3) -> str:
    """The tree level by level: up to 8 ** levels leaves of a language and
    8 ** group_levels languages."""
    def field(c: str) -> str:
        return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    def up(name: str, key: str, n: int, first: str) -> str:
        """Nodes and runs of each level over the nodes ``first``."""
        out, below = [], first
        for i in range(n):
            out.append(f"{name}r{i} AS (SELECT {key}, place // 8 AS place, list(h ORDER BY place) AS run FROM {below} GROUP BY {key}, place // 8)")
            out.append(f"{name}n{i} AS (SELECT {key}, place, CASE WHEN count(*) OVER (PARTITION BY {key}) = 1 AND len(run) = 1 "
                       f"THEN run[1] ELSE sha256(array_to_string(run, '')) END AS h FROM {name}r{i})")
            below = f"{name}n{i}"
        return ",\n".join(out)

    def down(name: str, key: str, n: int, first: str) -> str:
        """Each leaf's proof and folded digest, level by level upwards."""
        out, below = [], first
        for i in range(n):
            alone = f"(len(run) = 1 AND (SELECT count(*) FROM {name}r{i} z WHERE z.{key} = r.{key}) = 1)"
            out.append(
                f"{name}f{i} AS (SELECT f.* EXCLUDE (pos, proof, folded), pos // 8 AS pos, CASE WHEN {alone} THEN proof ELSE "
                f"proof || array_to_string(list_filter(run, lambda x, j: j <> pos % 8 + 1), '') END AS proof, "
                f"CASE WHEN {alone} THEN folded ELSE sha256(array_to_string(list_transform(run, lambda x, j: "
                f"CASE WHEN j = pos % 8 + 1 THEN folded ELSE x END), '')) END AS folded "
                f"FROM {below} f JOIN {name}r{i} r ON r.{key} = f.{key} AND r.place = f.pos // 8)")
            below = f"{name}f{i}"
        return ",\n".join(out)

    last, top = f"an{levels - 1}", f"bn{group_levels - 1}"
    return f"""
WITH poly AS (SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, v)
        ORDER BY v) AS p FROM (SELECT unnest(range(256)) AS v)),
t AS (SELECT *, coalesce('=' || lang, '-') AS g, translate(text, {_A_TO_Z}) AS small,
        xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
            lambda c, x: xor(c // 256, p[xor(c % 256, x) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 3 = 0 AS third
      FROM documents, poly),
l AS (SELECT *, {leaf('text')} AS leaf, {leaf('small')} AS other FROM t),
a AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
a0 AS (SELECT g, pos AS place, leaf AS h FROM a),
{up('a', 'g', levels, 'a0')},
sub AS (SELECT g, h FROM {last}),
b AS (SELECT *, row_number() OVER (ORDER BY g) - 1 AS place, 0 AS k FROM sub),
b0 AS (SELECT k, place, h FROM b),
{up('b', 'k', group_levels, 'b0')},
f AS (SELECT doc_id, g, pos, leaf, '' AS proof, CASE WHEN third THEN other ELSE leaf END AS folded FROM a),
{down('a', 'g', levels, 'f')},
h AS (SELECT x.doc_id, x.leaf, x.proof, x.folded, b.h AS subroot, b.place AS pos, 0 AS k FROM af{levels - 1} x JOIN b USING (g)),
{down('b', 'k', group_levels, 'h')}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM bf{group_levels - 1}, (SELECT h AS root FROM {top})"""


_OP13 = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
        unnest(regexp_split_to_array(translate(coalesce(text, ''), {_A_TO_Z}), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS l FROM p),
totals AS (SELECT lang, CAST(sum(len(l)) AS HUGEINT) AS n FROM w GROUP BY lang),
f AS (SELECT lang, k, phrase, CAST(count(*) AS HUGEINT) AS a FROM (
        SELECT lang, k, array_to_string(l[i:i + k - 1], ' ') AS phrase
        FROM (SELECT lang, l, k, unnest(range(1, len(l) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4), (5)) v(k)))
      GROUP BY lang, k, phrase HAVING count(*) >= 100),
cuts AS (SELECT lang, k, phrase, a, i, string_split(phrase, ' ') AS s
         FROM (SELECT *, unnest(range(1, k)) AS i FROM f WHERE k > 1)),
scored AS (SELECT c.lang, c.k, c.phrase, c.a, x.a AS l, y.a AS r, t.n, c.i, 1000 * c.a * t.n // (x.a * y.a) AS score
           FROM cuts c JOIN totals t USING (lang)
           JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.s[1:c.i], ' ')
           JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.s[c.i + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.lang = b.lang AND f.k > b.k AND 100 * f.a >= 100 * b.a
           AND contains(' ' || f.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, CAST(a AS BIGINT) AS a,
       CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept QUALIFY rank <= 2000"""

ORACLE_SQL: dict[str, str] = {"op11_suffix_dedup": _OP11, "op12_merkle_rollup": _op12(), "op13_setm_phrases": _OP13,
                              "op6_stream_dedup": _OP6, "op7_trie_join": _OP7, "op9_line_rules": _OP9}
