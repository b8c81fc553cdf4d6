"""DuckDB oracle SQL for the registered queries.

Written independently of the Spark plans, from the definitions in
CTEs it needs. Complete linkage is a recursive CTE: a step is one round of
mutual-best merges, and it ends when no edge is left.
"""

from __future__ import annotations

import re

from ..fixtures import CATEGORIES, DEFAULT_MASK, DEFAULT_NEWS_AMOUNT, REQUEST_LETTERS
from ..functions.text import BOILERPLATE_LABELS, HTML_ENTITIES
from .queries import (HEADLINE_WORDS, RANGE_DAY, SCAN_END, SCAN_START, SNAPSHOT_DAY,
                      SUMMARY_SENTENCES, TODAY, TOP_K, TOP_SLOT)

THRESHOLD = 0.3
# Unicode White_Space, as Java's (?U)\s
WS = r"[\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _slot_cols(ts: str) -> str:
    return (f"CAST({ts} + INTERVAL 3 HOUR AS DATE) AS digest_date, "
            f"CAST(CASE WHEN hour({ts}) >= 21 OR hour({ts}) < 7 THEN 1 WHEN hour({ts}) < 12 THEN 2 "
            f"WHEN hour({ts}) < 17 THEN 3 ELSE 4 END AS INTEGER) AS part")


def _part(ts: str) -> str:
    return (f"CAST(CASE WHEN hour({ts}) >= 21 OR hour({ts}) < 7 THEN 1 WHEN hour({ts}) < 12 THEN 2 "
            f"WHEN hour({ts}) < 17 THEN 3 ELSE 4 END AS INTEGER)")


NUMERIC = r"&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"


def _numeric(x: str) -> str:
    """Numeric entities by a fold over the distinct ones of the text."""
    digits = r"regexp_extract(e, '([0-9a-fA-F]+);$', 1)"
    code = (f"CASE WHEN lower(e[3]) = 'x' THEN CAST('0x' || {digits} AS BIGINT) "
            f"ELSE TRY_CAST({digits} AS BIGINT) END")
    ok = f"({code}) > 0 AND ({code}) < 1114112 AND NOT ({code}) BETWEEN 55296 AND 57343"
    char = f"CASE WHEN ({code}) = 38 THEN '&amp;' WHEN {ok} THEN chr(CAST({code} AS INTEGER)) ELSE e END"
    found = f"list_transform(regexp_extract_all({x}, {_q(NUMERIC)}), lambda e: {char})"
    between = f"string_split_regex({x}, {_q(NUMERIC)})"
    zipped = f"list_zip({between}, list_append({found}, ''))"
    return (f"CASE WHEN regexp_matches({x}, {_q(NUMERIC)}) THEN array_to_string(list_transform({zipped}, "
            f"lambda p: p[1] || p[2]), '') ELSE {x} END")


def _entities(x: str) -> str:
    x = _numeric(x)
    for ent, ch in HTML_ENTITIES:
        x = f"replace({x}, {_q(ent)}, {_q(ch)})"
    return x


NON_CONTENT = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"


def html_to_text(x: str) -> str:
    return _entities(f"regexp_replace(regexp_replace({x}, {_q(NON_CONTENT)}, '', 'g'), '<[^>]*>', '', 'g')")


def flatten_space(x: str) -> str:
    return f"replace(replace({x}, chr(160), ' '), chr(10), ' ')"


def strip_labels(x: str) -> str:
    for lab in BOILERPLATE_LABELS:
        x = f"replace({x}, {_q(lab)}, chr(10))"
    return x


def clean_text(x: str) -> str:
    return strip_labels(flatten_space(html_to_text(x)))


def first_link(x: str) -> str:
    tag = rf"regexp_extract(regexp_replace({x}, {_q(NON_CONTENT)}, '', 'g'), '(?i)(<a(?:\s[^>]*)?>)', 1)"
    raw = rf"""regexp_extract({tag}, '(?i)\shref\s*=\s*("[^"]*"|''[^'']*''|[^\s>"'']+)', 1)"""
    href = _entities(rf"""regexp_replace({raw}, '^["'']|["'']$', '', 'g')""")
    return f"(CASE WHEN {href} = '' OR starts_with({href}, 'tg://resolve?domain=') THEN NULL ELSE {href} END)"


def capitalise(x: str) -> str:
    return f"(upper(substr({x}, 1, 1)) || lower(substr({x}, 2)))"


def mask_categories(mask: str) -> str:
    parts = [f"CASE WHEN ({mask} & {1 << (i - 1)}) > 0 THEN {_q(c)} END" for i, c, _, _ in CATEGORIES]
    return f"concat_ws(',', {', '.join(parts)})"


CATEGORY_VALUES = ", ".join(f"({o}, {_q(c)}, {_q(t)}, {_q(e)})" for o, c, t, e in CATEGORIES)
COORDS = r"^([0-9]+) ([0-9]+)$"
SETTINGS = r"^([^ ]+) ([0-9]+)(?: .*)?$"
KIND = rf"""CASE WHEN regexp_matches(text, '^\d{{4}}-\d{{1,2}}-\d{{1,2}}$') AND try_strptime(text, '%Y-%m-%d') IS NOT NULL THEN 'digest'
  WHEN regexp_matches(substr(text, 1, 1), '^[0-9]$') THEN CASE WHEN regexp_matches(text, '{COORDS}') THEN 'coordinates' ELSE 'invalid' END
  WHEN regexp_matches(substr(text, 1, 1), '^\p{{L}}$') THEN CASE WHEN regexp_matches(text, '{SETTINGS}') THEN 'settings' ELSE 'invalid' END
  ELSE 'ignored' END"""

# name -> (sql body, dependencies)
CTES: dict[str, tuple[str, list[str]]] = {}


def cte(name: str, deps: list[str], body: str) -> None:
    CTES[name] = (body, deps)


cte("categories", [], f"SELECT * FROM (VALUES {CATEGORY_VALUES}) t(ordinal, category, title, emoji)")
WORDS = "list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}]+'), lambda w: w <> '')"


def sentence_ctes(texts: str, p: str = "") -> list[tuple[str, list[str], str]]:
    """Scored sentences of ``texts`` (doc_id, text)."""
    return [
        (f"{p}sents", [texts], f"""SELECT doc_id, sid, trim(raw) AS sentence FROM (
  SELECT doc_id, unnest(l) AS raw, generate_subscripts(l, 1) AS sid FROM (
    SELECT doc_id, regexp_extract_all(text, '[^.!?\\n]+[.!?]*') AS l FROM {texts})) WHERE trim(raw) <> ''"""),
        (f"{p}sw", [f"{p}sents"], "SELECT doc_id, sid, unnest(" + WORDS.format(x="sentence") + f") AS word FROM {p}sents"),
        (f"{p}tf", [f"{p}sw"], f"SELECT doc_id, word, count(*) AS tf FROM {p}sw GROUP BY ALL"),
        (f"{p}sc", [f"{p}sw", f"{p}tf"], f"""SELECT w.doc_id, w.sid, sum(t.tf) / count(*) AS score
  FROM {p}sw w JOIN {p}tf t USING (doc_id, word) GROUP BY ALL"""),
        (f"{p}best", [f"{p}sc", f"{p}sents"], f"""SELECT c.*, s.sentence,
  row_number() OVER (PARTITION BY c.doc_id ORDER BY score DESC, c.sid) AS rn
  FROM {p}sc c JOIN {p}sents s USING (doc_id, sid)"""),
        (f"{p}grams", [f"{p}best"], f"""SELECT doc_id, sid, rn, list_transform(range(1, len(l) - 2), lambda i:
  array_to_string(l[i:i + 3], ' ')) AS g FROM (SELECT doc_id, sid, rn, {WORDS.format(x='sentence')} AS l FROM {p}best)"""),
        # one more sentence a round: the best behind the last one taken that shares no four words with any taken
        *[(f"{p}taken{i}", [f"{p}grams"] + [f"{p}taken{i - 1}"] * (i > 0), f"""SELECT doc_id, min(rn) AS rn FROM {p}grams b
  WHERE """ + (f"""rn > (SELECT t.rn FROM {p}taken{i - 1} t WHERE t.doc_id = b.doc_id) AND NOT EXISTS (
    SELECT 1 FROM ({' UNION ALL '.join(f'SELECT * FROM {p}taken{j}' for j in range(i))}) t JOIN {p}grams a USING (doc_id, rn)
    WHERE a.doc_id = b.doc_id AND list_has_any(a.g, b.g))""" if i else "rn = 1") + " GROUP BY doc_id")
          for i in range(SUMMARY_SENTENCES)],
        (f"{p}short", [f"{p}best", f"{p}taken{SUMMARY_SENTENCES - 1}"], f"""SELECT doc_id,
  string_agg(sentence, ' ' ORDER BY sid) FILTER (rn IN (SELECT t.rn FROM ({' UNION ALL '.join(
      f'SELECT * FROM {p}taken{j}' for j in range(SUMMARY_SENTENCES))}) t WHERE t.doc_id = b.doc_id)) AS summary,
  max(array_to_string(list_slice(list_filter(regexp_split_to_array(sentence, '\\s+'), lambda t: t <> ''),
    1, {HEADLINE_WORDS}), ' ')) FILTER (rn = 1) AS headline FROM {p}best b GROUP BY doc_id"""),
    ]


cte("texts", [], "SELECT doc_id, text FROM documents")
for _c in sentence_ctes("texts"):
    cte(*_c)
cte("articles", ["short"], """
SELECT d.source AS agency, d.doc_id AS "index", e.ts AS date,
       coalesce(s.headline, '') AS title, coalesce(s.summary, '') AS short_news,
       CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE 'https://ex.org/' || CAST(d.doc_id % 50 AS VARCHAR) END AS first_link,
       d.text AS raw_news, e.event_type AS category
FROM documents d JOIN events e ON e.event_id = d.doc_id * 5 LEFT JOIN short s USING (doc_id)""")
cte("posts", [], """
SELECT d.source AS agency, d.doc_id AS "index", e.ts AS date, d.text AS raw_news
FROM documents d JOIN events e ON e.event_id = d.doc_id * 5""")
cte("slotted", ["articles"], f"SELECT *, {_slot_cols('date')} FROM articles")
cte("cut", ["posts"], """SELECT min(date) + to_microseconds((epoch_us(max(date)) - epoch_us(min(date))) // 2) AS cut FROM posts""")
cte("stored", ["posts", "cut"], "SELECT * FROM posts WHERE date < (SELECT cut FROM cut)")
cte("tokens", ["slotted"], rf"""
SELECT digest_date, part, "index", CAST(pos - 1 AS INTEGER) AS pos, tok,
       lower(trim(regexp_replace(tok, '[^\p{{L}}-]', '', 'g'), '-')) AS word
FROM (SELECT digest_date, part, "index", unnest(l) AS tok, generate_subscripts(l, 1) AS pos
      FROM (SELECT *, list_filter(regexp_split_to_array(title, '{WS}'), lambda t: t <> '') AS l FROM slotted))""")
cte("vocab", ["tokens"], """
SELECT word, ('0x' || substr(md5(word), 1, 8))::BIGINT % (SELECT count(*) FROM embeddings) AS vec_id
FROM tokens WHERE word <> '' GROUP BY word HAVING count(DISTINCT "index") >= 2""")
cte("tokvec", ["tokens", "vocab"], """
SELECT t.*, coalesce(v.vec_id, 0) AS vec_id FROM tokens t LEFT JOIN vocab v USING (word)""")
cte("vectors", ["tokvec"], """
SELECT "index", list(v ORDER BY dim) AS vec FROM (
  SELECT tv."index", el.dim, avg(el.x) AS v
  FROM tokvec tv JOIN (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS dim
                       FROM embeddings) el USING (vec_id)
  GROUP BY ALL) GROUP BY ALL""")
cte("views", ["slotted"], """
SELECT CAST(g.digest_date AS DATE) AS digest_date, CAST(g.part AS INTEGER) AS part,
  CAST(CASE WHEN p.part IS NULL THEN g.digest_date - INTERVAL 1 DAY ELSE g.digest_date END AS DATE) AS src_date,
  CAST(CASE WHEN p.part IS NULL THEN 0 ELSE g.part END AS INTEGER) AS src_part
FROM (SELECT CAST(t.g AS DATE) AS digest_date, v.p AS part
      FROM generate_series((SELECT min(digest_date) FROM slotted), (SELECT max(digest_date) FROM slotted),
                           INTERVAL 1 DAY) t(g), (VALUES (1), (2), (3), (4)) v(p)) g
LEFT JOIN (SELECT DISTINCT digest_date, part FROM slotted) p ON p.digest_date = g.digest_date AND p.part = g.part""")
cte("allviews", ["views", "slotted"], """
SELECT digest_date, part, src_date, src_part FROM views
UNION ALL SELECT DISTINCT CAST(date AS DATE), CAST(0 AS INTEGER), CAST(date AS DATE), CAST(0 AS INTEGER) FROM slotted""")
cte("vslotted", ["slotted"], """
SELECT * FROM slotted
UNION ALL
SELECT * REPLACE (CAST(date AS DATE) AS digest_date, CAST(0 AS INTEGER) AS part) FROM slotted""")
cte("bags", ["tokvec"], 'SELECT "index", list(vec_id ORDER BY vec_id) AS bag FROM tokvec GROUP BY ALL')
cte("norms", ["vectors", "bags"], """
SELECT v."index", b.bag, v.vec, sqrt(list_sum(list_transform(v.vec, lambda x: x * x))) AS nrm
FROM vectors v JOIN bags b USING ("index")""")
cte("members", ["vslotted", "norms"], """
SELECT s.digest_date, s.part, s."index", min(s."index") OVER w AS node, count(*) OVER w AS copies
FROM vslotted s LEFT JOIN norms n ON n."index" = s."index" AND n.nrm > 0
WINDOW w AS (PARTITION BY s.digest_date, s.part, n.bag, CASE WHEN n.bag IS NULL THEN s."index" END)""")
cte("unitv", ["members", "norms"], """
SELECT m.digest_date, m.part, m."index", m.copies, list_transform(n.vec, lambda x: x / n.nrm) AS u
FROM members m JOIN norms n USING ("index") WHERE n.nrm > 0 AND m."index" = m.node""")
cte("pairs", ["unitv"], f"""
SELECT * FROM (
  SELECT a.digest_date, a.part, a."index" AS a, b."index" AS b, a.copies AS wa, b.copies AS wb,
         floor((1 - list_dot_product(a.u, b.u)) * 1e6 + 0.501) / 1e6 AS d
  FROM unitv a JOIN unitv b ON a.digest_date = b.digest_date AND a.part = b.part AND a."index" < b."index")
WHERE d < {THRESHOLD}""")
# One row per edge of the cluster graph (kind 0) and per merge (kind 1: hi goes
# into lo). A step merges the pairs that are each other's best; complete pairs
# only are kept, so it ends when none is left.
cte("rounds", ["pairs"], """
  SELECT 0 AS kind, digest_date, part, a AS lo, b AS hi, CAST(wa * wb AS BIGINT) AS n, d AS dmax,
         CAST(wa AS BIGINT) AS s_lo, CAST(wb AS BIGINT) AS s_hi FROM pairs
  UNION ALL (
  WITH c AS (SELECT *, md5(CAST(lo AS VARCHAR) || ',' || CAST(hi AS VARCHAR)) AS h FROM rounds
             WHERE kind = 0 AND n = s_lo * s_hi),
  ends AS (SELECT digest_date, part, lo AS cl, lo, hi, dmax, h FROM c
           UNION ALL SELECT digest_date, part, hi, lo, hi, dmax, h FROM c),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY digest_date, part, cl ORDER BY dmax, h, lo, hi) AS rn
                          FROM ends) WHERE rn = 1),
  m AS (SELECT c.* FROM c JOIN best x ON x.digest_date = c.digest_date AND x.part = c.part AND x.cl = c.lo AND x.lo = c.lo
            AND x.hi = c.hi
          JOIN best y ON y.digest_date = c.digest_date AND y.part = c.part AND y.cl = c.hi AND y.lo = c.lo AND y.hi = c.hi),
  moved AS (SELECT digest_date, part, hi AS id, lo AS new_id, s_lo + s_hi AS s FROM m
            UNION ALL SELECT digest_date, part, lo, lo, s_lo + s_hi FROM m),
  g AS (SELECT c.digest_date, c.part, coalesce(p.new_id, c.lo) AS x, coalesce(q.new_id, c.hi) AS y,
               coalesce(p.s, c.s_lo) AS sx, coalesce(q.s, c.s_hi) AS sy, c.n, c.dmax
        FROM c LEFT JOIN moved p ON p.digest_date = c.digest_date AND p.part = c.part AND p.id = c.lo
               LEFT JOIN moved q ON q.digest_date = c.digest_date AND q.part = c.part AND q.id = c.hi)
  SELECT 0, digest_date, part, least(x, y), greatest(x, y), CAST(sum(n) AS BIGINT), max(dmax),
         max(CASE WHEN x < y THEN sx ELSE sy END), max(CASE WHEN x < y THEN sy ELSE sx END)
  FROM g WHERE x <> y GROUP BY digest_date, part, least(x, y), greatest(x, y)
  UNION ALL SELECT 1, digest_date, part, lo, hi, n, dmax, s_lo, s_hi FROM m)""")
cte("chains", ["rounds"], """
  SELECT digest_date, part, hi AS node, lo AS cid FROM rounds WHERE kind = 1
  UNION ALL SELECT c.digest_date, c.part, c.node, r.lo FROM chains c JOIN rounds r
    ON r.kind = 1 AND r.digest_date = c.digest_date AND r.part = c.part AND r.hi = c.cid""")
cte("clustered", ["vslotted", "members", "chains"], """
SELECT s.*, coalesce(f.cid, m.node) AS cid,
       count(*) OVER (PARTITION BY s.digest_date, s.part, coalesce(f.cid, m.node)) AS size
FROM vslotted s JOIN members m ON m.digest_date = s.digest_date AND m.part = s.part AND m."index" = s."index"
LEFT JOIN (SELECT digest_date, part, node, min(cid) AS cid FROM chains GROUP BY ALL) f
  ON f.digest_date = s.digest_date AND f.part = s.part AND f.node = m.node""")
cte("labelled", ["clustered"], """
SELECT c.*, l.label FROM clustered c JOIN (
  SELECT digest_date, part, cid, row_number() OVER (PARTITION BY digest_date, part ORDER BY size DESC, cid) AS label
  FROM (SELECT DISTINCT digest_date, part, cid, size FROM clustered)) l USING (digest_date, part, cid)""")
cte("story", ["labelled"], """
SELECT digest_date, part, label, max(size) AS size, min(date) AS date, min(agency) AS agency,
       min(category) AS category, min(title) AS title, min(short_news) AS short_news
FROM labelled GROUP BY digest_date, part, label""")
cte("ranked", ["story"], """
SELECT *, row_number() OVER (PARTITION BY digest_date, part, category ORDER BY size DESC, label) AS rank FROM story""")
cte("links", ["labelled"], """
SELECT DISTINCT digest_date, part, label, unnest(string_split(
  concat_ws(' ', first_link, 'https://t.me/' || agency || '/' || CAST("index" AS VARCHAR)), ' ')) AS link
FROM labelled""")
cte("settings_log", [], """
SELECT o_custkey AS user_id, o_orderdate AS updated_at, o_orderkey AS seq, o_orderstatus <> 'F' AS is_subscribed,
       CAST(1 + o_orderkey % 5 AS INTEGER) AS news_amount, CAST(1 + o_orderkey % 31 AS INTEGER) AS mask
FROM orders""")
cte("latest", ["settings_log"], """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, seq DESC) AS rn
  FROM settings_log) WHERE rn = 1""")
cte("subs", ["latest"], "SELECT * FROM latest WHERE is_subscribed")
cte("users", [], "SELECT c_custkey AS user_id, c_name AS first_name FROM customer WHERE c_custkey % 5 <> 4")
cte("percat", ["subs", "categories"], """
SELECT s.user_id, s.news_amount, c.category,
       CAST(row_number() OVER (PARTITION BY s.user_id ORDER BY c.ordinal) AS INTEGER) AS category_no
FROM subs s JOIN categories c ON (s.mask & (1 << (c.ordinal - 1))) > 0""")
cte("lines", ["percat", "ranked", "views"], """
SELECT p.user_id, v.digest_date, v.part, p.category_no, p.category, r.rank, r.label, r.title
FROM percat p JOIN ranked r USING (category)
JOIN views v ON v.src_date = r.digest_date AND v.src_part = r.part
WHERE r.rank <= p.news_amount""")
cte("requests", [], rf"""
SELECT event_id AS request_id, user_id, ts AS sent_at,
  CASE event_type
    WHEN 'view' THEN CASE WHEN k % 2 = 0 THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%Y-%-m-%-d') END
    WHEN 'click' THEN CAST(1 + k % 5 AS VARCHAR) || ' ' || CAST(1 + k % 7 AS VARCHAR)
    WHEN 'signup' THEN upper(substr({_q(REQUEST_LETTERS)}, 1 + k % 5, 1)) || substr({_q(REQUEST_LETTERS)}, 1 + (k // 5) % 5, 1)
                       || ' ' || CAST(1 + k % 4 AS VARCHAR)
    WHEN 'purchase' THEN substr({_q(REQUEST_LETTERS)}, 1 + k % 4, 2)
    ELSE '?!' END AS text
FROM (SELECT *, TRY_CAST(regexp_extract(props, '"k":\s*(\d+)', 1) AS INTEGER) AS k FROM events)""")
cte("kinds", ["requests"], f"SELECT *, {KIND} AS kind FROM requests")
cte("dlog", [], f"""SELECT user_id, sent_at, CASE WHEN event_id % 2 = 0 THEN CAST(sent_at AS DATE) ELSE digest_date END AS digest_date,
  CASE WHEN event_id % 2 = 0 THEN 0 ELSE part END AS part
  FROM (SELECT event_id, user_id, ts AS sent_at, {_slot_cols('ts')} FROM events WHERE event_type = 'view')""")
cte("asof_last", ["kinds", "dlog"], """
SELECT r.request_id, r.user_id, r.text, d.sent_at AS digest_sent_at, d.digest_date, d.part
FROM (SELECT * FROM kinds WHERE kind = 'coordinates') r
ASOF LEFT JOIN dlog d ON r.user_id = d.user_id AND r.sent_at >= d.sent_at""")
cte("resolved", ["asof_last", "percat", "ranked", "allviews"], rf"""
SELECT a.request_id, a.user_id, a.digest_date, a.part, v.src_date, v.src_part, p.category, r.label,
       strftime(date_trunc('second', r.date), '%d %B %Y - %H:%M:%S') AS shown_date, r.title,
       replace(r.short_news, r.title || '. ', '') AS summary
FROM (SELECT *, CAST(regexp_extract(text, '{COORDS}', 1) AS INTEGER) AS category_no,
             CAST(regexp_extract(text, '{COORDS}', 2) AS BIGINT) AS label FROM asof_last WHERE digest_date IS NOT NULL) a
JOIN percat p ON p.user_id = a.user_id AND p.category_no = a.category_no
JOIN allviews v ON v.digest_date = a.digest_date AND v.part = a.part
JOIN ranked r ON r.digest_date = v.src_date AND r.part = v.src_part AND r.category = p.category AND r.label = a.label
WHERE r.rank <= p.news_amount""")
cte("setreq", ["kinds"], f"""
SELECT request_id, user_id, sent_at, lower(regexp_extract(text, '{SETTINGS}', 1)) AS letters,
       CAST(regexp_extract(text, '{SETTINGS}', 2) AS INTEGER) AS news_amount
FROM kinds WHERE kind = 'settings'""")
cte("firstcat", ["categories"], """
SELECT letter, category FROM (SELECT lower(substr(title, 1, 1)) AS letter, category,
  row_number() OVER (PARTITION BY lower(substr(title, 1, 1)) ORDER BY ordinal) AS rn FROM categories) WHERE rn = 1""")
cte("letters", ["setreq", "firstcat"], """
SELECT l.request_id, l.pos, l.letter, f.category FROM (
  SELECT request_id, CAST(generate_subscripts(string_split(letters, ''), 1) - 1 AS INTEGER) AS pos,
         unnest(string_split(letters, '')) AS letter FROM setreq) l
LEFT JOIN firstcat f USING (letter)""")
cte("applied", ["setreq", "subs", "letters", "categories"], """
SELECT r.request_id, r.user_id, r.sent_at AS updated_at, r.request_id AS seq, true AS is_subscribed, r.news_amount,
       CAST(sum(DISTINCT 1 << (c.ordinal - 1)) AS INTEGER) AS mask
FROM setreq r JOIN letters l USING (request_id) JOIN categories c USING (category)
WHERE r.user_id IN (SELECT user_id FROM subs)
  AND r.request_id NOT IN (SELECT request_id FROM letters WHERE category IS NULL)
GROUP BY r.request_id, r.user_id, r.sent_at, r.news_amount""")


def _messages() -> str:
    return """SELECT agency, "index", date_trunc('second', date) AS date, raw_news AS message
              FROM posts WHERE raw_news IS NOT NULL AND raw_news <> ''"""


cte("messages", ["posts"], _messages())


def _closure(names: list[str]) -> list[str]:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][1]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    return order


def with_ctes(needed: list[str], select: str) -> str:
    """Prefix the CTEs ``needed`` (and what they depend on); a select with its
    own WITH clause is merged into the same list."""
    names = _closure(needed)
    parts = []
    for n in names:
        body = CTES[n][0]
        mat = " MATERIALIZED" if re.fullmatch(r"rounds|chains|pairs|vectors|unitv|members|norms|bags|tokens|short|articles|clustered|labelled|story|ranked|ishort|icleaned", n) else ""
        parts.append(f"{n} AS{'' if n in RECURSIVE else mat} ({body})")
    select = select.strip()
    if select.upper().startswith("WITH "):
        parts.append(select[5:])
        return "WITH RECURSIVE " + ",\n".join(parts)
    if not parts:
        return select
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + select


RECURSIVE = {"rounds", "chains"}


def _d(c: str) -> str:
    return f"CAST({c} AS VARCHAR)"


SLOT_OUT = "CAST(digest_date AS VARCHAR) AS digest_date, part"
ORACLE_SQL: dict[str, str] = {}


def q(name: str, needed: list[str], select: str) -> None:
    ORACLE_SQL[name] = with_ctes(needed, select)


# --- sources and sinks
q("scan_messages", ["messages"], f'SELECT agency, "index", {_d("date")} AS date, message FROM messages')
q("scan_bad_messages", ["posts"], """SELECT agency, CASE WHEN page % 3 = 0 THEN 'unparsable' ELSE 'no messages' END AS reason,
  '{"page": ' || CAST(page AS VARCHAR) || CASE WHEN page % 3 = 0 THEN ', "messages": [{"id": 1' ELSE '}' END AS record
  FROM (SELECT DISTINCT agency, "index" // 100 AS page FROM posts) WHERE page % 3 < 2""")
q("scan_range", ["articles"], f"""SELECT agency, "index", {_d('date')} AS date FROM articles
  WHERE date >= TIMESTAMP {_q(SCAN_START)} AND date < TIMESTAMP {_q(SCAN_END)}""")
q("active_sources", ["articles"], """SELECT agency, "index" FROM articles
  WHERE CAST(regexp_extract(agency, '(\\d+)$', 1) AS INTEGER) % 2 = 0""")
q("sink_articles", ["slotted"], f'SELECT agency, "index", {SLOT_OUT}, category, title FROM slotted')
q("sink_user_log", ["settings_log", "applied"], f"""
SELECT user_id, seq, is_subscribed, news_amount, {mask_categories('mask')} AS categories FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, seq DESC) AS rn FROM (
    SELECT user_id, updated_at, seq, is_subscribed, news_amount, mask FROM settings_log
    UNION ALL SELECT user_id, updated_at, seq, is_subscribed, news_amount, mask FROM applied)) WHERE rn = 1""")
q("snapshot", ["articles"], f"SELECT {_q(SNAPSHOT_DAY)} AS snapshot_date, agency, count(*) AS n_articles FROM articles GROUP BY agency")

INCREMENTAL = """SELECT a.* FROM posts a LEFT JOIN (
    SELECT agency, "index" AS hw FROM (SELECT agency, "index",
      row_number() OVER (PARTITION BY agency ORDER BY date DESC, "index" DESC) AS rn FROM stored) WHERE rn = 1) h
  USING (agency) WHERE a."index" > coalesce(h.hw, 0) AND a.raw_news IS NOT NULL AND a.raw_news <> ''"""
q("ingest_metrics", ["posts", "stored"], f"""SELECT agency, count(*) AS n_articles, {_d('min(date)')} AS first_date,
  {_d('max(date)')} AS last_date FROM ({INCREMENTAL}) GROUP BY agency""")
q("stream_metrics", ["posts", "stored"], f"""SELECT agency, count(*) AS n_articles,
  {_d("date_trunc('second', min(date))")} AS first_date, {_d("date_trunc('second', max(date))")} AS last_date
  FROM ({INCREMENTAL}) WHERE CAST(regexp_extract(agency, '(\\d+)$', 1) AS INTEGER) % 2 = 0 GROUP BY agency""")
# --- filters
q("incremental_filter", ["posts", "stored"], f'SELECT agency, "index" FROM ({INCREMENTAL})')
q("drop_empty", [], f"""SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars FROM (
  SELECT doc_id, {clean_text('text')} AS t FROM documents) WHERE length(t) > 0""")
_bounds = {0: ("00:00:00", 0, "00:00:00", 1), 1: ("21:00:00", -1, "07:00:00", 0), 2: ("07:00:00", 0, "12:00:00", 0),
           3: ("12:00:00", 0, "17:00:00", 0), 4: ("17:00:00", 0, "21:00:00", 0)}
q("slot_range", ["articles"], " UNION ALL ".join(
    f"""SELECT {p} AS part, "index" FROM articles WHERE
      date >= CAST(DATE {_q(RANGE_DAY)} + INTERVAL ({sd}) DAY AS TIMESTAMP) + INTERVAL {_q(st)}
      AND date < CAST(DATE {_q(RANGE_DAY)} + INTERVAL ({ed}) DAY AS TIMESTAMP) + INTERVAL {_q(et)}"""
    for p, (st, sd, et, ed) in _bounds.items()))
q("subscribed_users", ["subs"], f"SELECT user_id, news_amount, {mask_categories('mask')} AS categories FROM subs")
q("date_guard", ["kinds"], f"""SELECT request_id, {_d("CAST(strptime(text, '%Y-%m-%d') AS DATE)")} AS req_date,
  CAST(strptime(text, '%Y-%m-%d') AS DATE) BETWEEN DATE '2022-06-28' AND DATE {_q(TODAY)} AS is_valid
  FROM kinds WHERE kind = 'digest'""")
q("slot_fallback", ["views"], f"""SELECT {SLOT_OUT}, {_d('src_date')} AS src_date, src_part FROM views""")
q("settings_unpivot", ["settings_log", "categories"], """
SELECT s.user_id, s.seq, CAST(c.ordinal AS INTEGER) AS ordinal, c.category
FROM settings_log s JOIN categories c ON (s.mask & (1 << (c.ordinal - 1))) > 0""")
q("settings_apply", ["applied"], f"SELECT request_id, user_id, news_amount, {mask_categories('mask')} AS categories FROM applied")
# --- joins
q("category_lookup", ["articles", "categories"], f"""SELECT a."index", a.category, {capitalise('c.title')} AS category_title, c.emoji
  FROM articles a JOIN categories c USING (category)""")
q("semi_subscribed", ["requests", "subs"], "SELECT request_id, user_id FROM requests WHERE user_id IN (SELECT user_id FROM subs)")
q("subscribe_actions", ["latest"], """SELECT e.event_id AS request_id, e.user_id,
  CASE WHEN l.user_id IS NULL THEN 'insert' WHEN NOT l.is_subscribed THEN 'resubscribe' ELSE 'none' END AS action
  FROM events e LEFT JOIN latest l USING (user_id) WHERE e.event_type = 'signup'""")
q("settings_or_default", ["latest"], f"""SELECT c.c_custkey AS user_id,
  CASE WHEN l.user_id IS NOT NULL THEN 'own' ELSE 'default' END AS source,
  coalesce(l.is_subscribed, false) AS is_subscribed,
  CAST(CASE WHEN l.user_id IS NOT NULL THEN l.news_amount ELSE {DEFAULT_NEWS_AMOUNT} END AS INTEGER) AS news_amount,
  {mask_categories(f'CASE WHEN l.user_id IS NOT NULL THEN l.mask ELSE {DEFAULT_MASK} END')} AS categories
  FROM customer c LEFT JOIN (SELECT * FROM latest WHERE user_id % 5 <> 4
     AND user_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 4)) l ON l.user_id = c.c_custkey""")
q("token_vectors", ["tokvec"], 'SELECT "index", pos, word, vec_id FROM tokvec')
q("similar_pairs", ["pairs"], f"SELECT {SLOT_OUT}, a, b, d FROM pairs")
q("digest_lines", ["lines"], f"SELECT user_id, {SLOT_OUT}, category_no, category, rank, label, title FROM lines")
q("drilldown", ["resolved"], f"""SELECT request_id, user_id, {SLOT_OUT}, category, label, shown_date, title, summary
  FROM resolved""")
q("letter_match", ["letters"], "SELECT request_id, pos, letter, category FROM letters")
q("asof_digest", ["asof_last"], f"SELECT request_id, user_id, {_d('digest_sent_at')} AS digest_sent_at, {SLOT_OUT} FROM asof_last")
# --- aggregations
q("high_water", ["posts"], """SELECT agency, "index" AS high_water FROM (SELECT agency, "index",
  row_number() OVER (PARTITION BY agency ORDER BY date DESC, "index" DESC) AS rn FROM posts) WHERE rn = 1""")
q("cluster_size", ["clustered"], f'SELECT {SLOT_OUT}, "index", size FROM clustered')
q("cluster_min", ["story"], f"""SELECT {SLOT_OUT}, label, size, {_d('date')} AS date, agency, category, title, short_news
  FROM story""")
q("cluster_links", ["links"], f"SELECT {SLOT_OUT}, label, link FROM links")
q("article_vectors", ["vectors"], """SELECT "index", CAST(generate_subscripts(vec, 1) - 1 AS INTEGER) AS dim,
  floor(unnest(vec) * 1e6 + 0.50003719) / 1e6 AS value FROM vectors""")
cte("digests", ["lines", "categories", "users"], f"""
SELECT b.user_id, b.digest_date, b.part,
  coalesce(u.first_name, 'Reader') || ', hello!' || chr(10) || chr(10) || 'Your ' ||
  CASE b.part WHEN 1 THEN 'morning ' WHEN 2 THEN 'daytime ' WHEN 3 THEN 'evening ' WHEN 4 THEN 'night ' ELSE '' END ||
  'digest for' || chr(10) || strftime(b.digest_date, '%d %B %Y') || ':' || chr(10) || b.body AS text
FROM (SELECT user_id, digest_date, part, string_agg(t, '' ORDER BY category_no, r, t) AS body FROM (
    SELECT DISTINCT l.user_id, l.digest_date, l.part, l.category_no, 0 AS r,
      chr(10) || c.emoji || ' ' || CAST(l.category_no AS VARCHAR) || '. ' || {capitalise('c.title')} || ':' || chr(10) AS t
    FROM lines l JOIN categories c USING (category)
    UNION ALL
    SELECT user_id, digest_date, part, category_no, rank AS r,
      CAST(label AS VARCHAR) || '. ' || title || chr(10) AS t FROM lines) GROUP BY ALL) b
LEFT JOIN users u USING (user_id)""")
q("digest_text", ["digests"], f"SELECT user_id, {SLOT_OUT}, text FROM digests")
cte("delivered", ["digests"], """SELECT user_id, digest_date, part, text, CAST(digest_date AS TIMESTAMP)
  + to_hours(CASE part WHEN 1 THEN 8 WHEN 2 THEN 13 WHEN 3 THEN 18 ELSE 22 END) AS sent_at FROM digests""")
q("deliver_slot", ["delivered"], f"SELECT user_id, {SLOT_OUT}, {_d('sent_at')} AS sent_at, text FROM delivered")
q("deliver_asof", ["delivered", "kinds"], f"""SELECT request_id, user_id, {_d('digest_sent_at')} AS digest_sent_at, {SLOT_OUT} FROM (
  SELECT r.request_id, r.user_id, l.sent_at AS digest_sent_at, l.digest_date, l.part, row_number() OVER (
    PARTITION BY r.request_id ORDER BY l.sent_at DESC, l.digest_date DESC, l.part DESC) AS rn
  FROM kinds r LEFT JOIN delivered l ON l.user_id = r.user_id AND l.sent_at <= r.sent_at WHERE r.kind = 'coordinates') WHERE rn = 1""")
q("drilldown_links", ["resolved", "links"], f"""SELECT r.request_id, CAST(r.digest_date AS VARCHAR) AS digest_date, r.part,
  r.label, k.link FROM resolved r JOIN links k ON k.digest_date = r.src_date AND k.part = r.src_part
  AND k.label = r.label WHERE k.link <> 'https://t.me/economika'""")
# --- windows, sorts
q("top_clusters", ["ranked", "subs"], f"""SELECT {SLOT_OUT}, category, rank, label, size FROM ranked
  WHERE rank <= (SELECT max(news_amount) FROM subs)""")
q("category_numbers", ["percat"], "SELECT user_id, category_no, category FROM percat")
q("story_labels", ["labelled"], f'SELECT {SLOT_OUT}, "index", label FROM labelled')
q("latest_settings", ["latest"], f"SELECT user_id, seq, is_subscribed, news_amount, {mask_categories('mask')} AS categories FROM latest")
q("story_order", ["story"], f"""SELECT {SLOT_OUT}, label,
  row_number() OVER (PARTITION BY digest_date, part ORDER BY size DESC, label) AS position, size FROM story""")
q("top_stories", ["story"], f"""SELECT {SLOT_OUT}, label, size, title FROM story
  WHERE digest_date = DATE {_q(TOP_SLOT[0])} AND part = {TOP_SLOT[1]} ORDER BY size DESC, label LIMIT {TOP_K}""")
# --- set operations
q("merge_articles", ["articles", "cut"], """SELECT agency, "index",
  CASE WHEN date < (SELECT cut FROM cut) THEN title ELSE 'new: ' || title END AS title FROM articles""")
# --- scalar functions
q("first_link", [], f"SELECT page_id, {first_link('html')} AS first_link FROM pages")
q("html_text", [], f"SELECT page_id, {html_to_text('html')} AS text FROM pages")
q("clean_text", [], f"SELECT page_id, {clean_text('html')} AS text FROM pages")
q("strip_labels", [], f"SELECT doc_id, {strip_labels(flatten_space('text'))} AS text FROM documents")
q("article_links", ["articles"], """SELECT agency, "index",
  concat_ws(' ', first_link, 'https://t.me/' || agency || '/' || CAST("index" AS VARCHAR)) AS links FROM articles""")
q("clean_words", ["tokens"], 'SELECT "index", pos, tok, word FROM tokens')
q("label_suffix", [], "SELECT event_id, string_split('__label__' || event_type, '__')[-1] AS category FROM events")
q("epoch_time", ["articles"], """SELECT "index", epoch_us(date) // 1000000 AS epoch,
  CAST(make_timestamp((epoch_us(date) // 1000000) * 1000000) AS VARCHAR) AS utc_time,
  CAST(make_timestamp((epoch_us(date) // 1000000) * 1000000) + INTERVAL 3 HOUR AS VARCHAR) AS msk_time FROM articles""")
q("parse_date", ["kinds"], f"""SELECT request_id,
  CASE WHEN regexp_matches(text, '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}$') THEN {_d("CAST(try_strptime(text, '%Y-%m-%d') AS DATE)")} END AS parsed
  FROM kinds""")
q("display_date", ["slotted"], """SELECT "index", strftime(date_trunc('second', date), '%d %B %Y - %H:%M:%S') AS shown,
  strftime(digest_date, '%d %B %Y') AS shown_day FROM slotted""")
q("request_kind", ["kinds"], f"""SELECT request_id, kind,
  CASE WHEN regexp_matches(text, '{COORDS}') THEN CAST(regexp_extract(text, '{COORDS}', 1) AS INTEGER) END AS category_no,
  CASE WHEN regexp_matches(text, '{COORDS}') THEN CAST(regexp_extract(text, '{COORDS}', 2) AS INTEGER) END AS label,
  CASE WHEN regexp_matches(text, '{SETTINGS}') AND regexp_matches(substr(text, 1, 1), '^\\p{{L}}$')
       THEN lower(regexp_extract(text, '{SETTINGS}', 1)) END AS letters,
  CASE WHEN regexp_matches(text, '{SETTINGS}') AND regexp_matches(substr(text, 1, 1), '^\\p{{L}}$')
       THEN CAST(regexp_extract(text, '{SETTINGS}', 2) AS INTEGER) END AS news_amount
  FROM kinds""")
# --- text models
# Naive Bayes from the labelled documents, applied to ``{texts}`` (doc_id, text).
NB = """
classes(class) AS (VALUES ('not_news'), ('news')),
train AS (SELECT d.doc_id, d.text, CASE WHEN l.quality = 1 THEN 'news' ELSE 'not_news' END AS class
          FROM documents d JOIN labels l USING (doc_id)),
priors AS (SELECT class, ln(count(*) / sum(count(*)) OVER ()) AS logprior FROM train GROUP BY class),
counts AS (SELECT class, word, count(*) AS n FROM (SELECT class, unnest({train_words}) AS word FROM train) GROUP BY ALL),
vocabulary AS (SELECT DISTINCT word FROM counts),
totals AS (SELECT class, sum(n) AS total FROM counts GROUP BY class),
model AS (SELECT v.word, c.class, ln((coalesce(k.n, 0) + 1) / (t.total + (SELECT count(*) FROM vocabulary))) AS logp
          FROM vocabulary v CROSS JOIN classes c LEFT JOIN counts k ON k.word = v.word AND k.class = c.class
          JOIN totals t ON t.class = c.class),
dwc AS (SELECT doc_id, word, count(*) AS cnt FROM (SELECT doc_id, unnest({train_words}) AS word FROM {texts}) GROUP BY ALL),
ll AS (SELECT doc_id, class, sum(cnt * logp) AS ll FROM dwc JOIN model USING (word) GROUP BY ALL),
scored AS (SELECT d.doc_id, c.class, p.logprior + coalesce(ll.ll, 0) AS score
           FROM {texts} d CROSS JOIN classes c JOIN priors p USING (class) LEFT JOIN ll USING (doc_id, class)),
kept AS (SELECT doc_id, category FROM (SELECT doc_id, class AS category,
  row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, class DESC) AS rn FROM scored)
  WHERE rn = 1 AND category <> 'not_news')"""
q("classify_nb", [], "WITH " + NB.format(train_words=WORDS.format(x="text"), texts="documents")
  + "\nSELECT doc_id, category FROM kept")
q("classify_multi", [], f"""WITH train AS (SELECT d.doc_id, d.text, concat('q', l.quality, 't', l.toxic) AS class
          FROM documents d JOIN labels l USING (doc_id)),
priors AS (SELECT class, ln(count(*) / sum(count(*)) OVER ()) AS logprior FROM train GROUP BY class),
counts AS (SELECT class, word, count(*) AS n FROM (SELECT class, unnest({WORDS.format(x="text")}) AS word FROM train) GROUP BY ALL),
vocabulary AS (SELECT DISTINCT word FROM counts),
totals AS (SELECT p.class, coalesce(sum(n), 0) AS total FROM priors p LEFT JOIN counts USING (class) GROUP BY p.class),
model AS (SELECT v.word, c.class, ln((coalesce(k.n, 0) + 1) / (c.total + (SELECT count(*) FROM vocabulary))) AS logp
          FROM vocabulary v CROSS JOIN totals c LEFT JOIN counts k ON k.word = v.word AND k.class = c.class),
dwc AS (SELECT doc_id, word, count(*) AS cnt FROM (SELECT doc_id, unnest({WORDS.format(x="text")}) AS word FROM documents) GROUP BY ALL),
ll AS (SELECT doc_id, class, sum(cnt * logp) AS ll FROM dwc JOIN model USING (word) GROUP BY ALL)
SELECT doc_id, class AS category FROM (SELECT d.doc_id, p.class, row_number() OVER (PARTITION BY d.doc_id
  ORDER BY p.logprior + coalesce(ll.ll, 0) DESC, p.class DESC) AS rn
  FROM documents d CROSS JOIN priors p LEFT JOIN ll USING (doc_id, class)) WHERE rn = 1""")
q("summarise", ["short"], "SELECT doc_id, summary FROM short")
q("headline", ["short"], "SELECT doc_id, headline FROM short")
q("score_batches", [], r"""SELECT doc_id, CASE WHEN text IS NULL THEN 0.0 ELSE
  round(len(regexp_extract_all(text, '\p{L}')) / greatest(length(text), 1), 6) END AS score FROM documents""")
# --- stories, digests on demand, users
q("title_copies", ["members"], f'SELECT {SLOT_OUT}, "index", node FROM members')
for _name in ("story_clusters", "story_clusters_distributed", "late_refresh", "stream_late"):
    q(_name, ["labelled"], f'SELECT {SLOT_OUT}, "index", cid, size, label FROM labelled')
q("story_representative", ["labelled"], f"""SELECT {SLOT_OUT}, label, size, {_d('date')} AS date, agency, category, title,
  short_news FROM (SELECT *, row_number() OVER (PARTITION BY digest_date, part, label ORDER BY date, "index") AS rn
  FROM labelled) WHERE rn = 1""")
cte("wanted", ["kinds"], f"""SELECT request_id, user_id, CAST(strptime(text, '%Y-%m-%d') AS DATE) AS digest_date FROM kinds
  WHERE kind = 'digest' AND CAST(strptime(text, '%Y-%m-%d') AS DATE) BETWEEN DATE '2022-06-28' AND DATE {_q(TODAY)}""")
cte("own", ["latest"], "SELECT * FROM latest WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 4)")
cte("daypref", ["wanted", "own"], f"""SELECT u.user_id, coalesce(o.news_amount, {DEFAULT_NEWS_AMOUNT}) AS news_amount,
  coalesce(o.mask, {DEFAULT_MASK}) AS mask FROM (SELECT DISTINCT user_id FROM wanted) u LEFT JOIN own o USING (user_id)""")
cte("daycat", ["daypref", "categories"], """SELECT s.user_id, s.news_amount, c.category,
  CAST(row_number() OVER (PARTITION BY s.user_id ORDER BY c.ordinal) AS INTEGER) AS category_no
  FROM daypref s JOIN categories c ON (s.mask & (1 << (c.ordinal - 1))) > 0""")
cte("daylines", ["wanted", "daycat", "ranked"], """
SELECT w.request_id, w.user_id, w.digest_date, CAST(0 AS INTEGER) AS part, p.category_no, p.category, r.rank, r.label, r.title
FROM wanted w JOIN daycat p USING (user_id)
JOIN ranked r ON r.digest_date = w.digest_date AND r.part = 0 AND r.category = p.category WHERE r.rank <= p.news_amount""")
q("day_digest", ["daylines"], f"""SELECT request_id, user_id, {SLOT_OUT}, category_no, category, rank, label, title
  FROM daylines""")
q("day_digest_text", ["daylines", "categories", "users"], f"""
SELECT b.request_id, b.user_id, CAST(b.digest_date AS VARCHAR) AS digest_date, b.part,
  coalesce(u.first_name, 'Reader') || ', hello!' || chr(10) || chr(10) || 'Your digest for' || chr(10) ||
  strftime(b.digest_date, '%d %B %Y') || ':' || chr(10) || b.body AS text
FROM (SELECT request_id, user_id, digest_date, part, string_agg(t, '' ORDER BY category_no, r, t) AS body FROM (
    SELECT DISTINCT l.request_id, l.user_id, l.digest_date, l.part, l.category_no, 0 AS r,
      chr(10) || c.emoji || ' ' || CAST(l.category_no AS VARCHAR) || '. ' || {capitalise('c.title')} || ':' || chr(10) AS t
    FROM daylines l JOIN categories c USING (category)
    UNION ALL
    SELECT request_id, user_id, digest_date, part, category_no, rank AS r,
      CAST(label AS VARCHAR) || '. ' || title || chr(10) AS t FROM daylines) GROUP BY ALL) b
LEFT JOIN users u USING (user_id)""")
q("user_events", ["latest"], f"""
WITH cmd AS (SELECT event_id, user_id, ts, event_type = 'signup' AS sub FROM events WHERE event_type IN ('signup', 'error')),
st AS (SELECT c.*, l.user_id IS NOT NULL AS known, l.is_subscribed AS was, l.news_amount AS amount, l.mask,
    lag(sub) OVER w AS before,
    coalesce(bool_or(sub) OVER (PARTITION BY c.user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
             false) AS seen
  FROM cmd c LEFT JOIN latest l USING (user_id) WINDOW w AS (PARTITION BY c.user_id ORDER BY ts, event_id)),
act AS (SELECT *, CASE WHEN sub AND NOT (known OR seen) THEN 'insert'
    WHEN sub AND NOT coalesce(before, was, false) THEN 'resubscribe'
    WHEN NOT sub AND coalesce(before, was, false) AND (known OR seen) THEN 'unsubscribe' END AS action FROM st)
SELECT event_id AS seq, action, user_id, sub AS is_subscribed,
  CAST(CASE WHEN known THEN amount ELSE {DEFAULT_NEWS_AMOUNT} END AS INTEGER) AS news_amount,
  {mask_categories(f'CASE WHEN known THEN mask ELSE {DEFAULT_MASK} END')} AS categories FROM act WHERE action IS NOT NULL""")
q("location_log", [], rf"""SELECT user_id, {_d('ts')} AS sent_at,
  CAST(TRY_CAST(regexp_extract(props, '"k":\s*(\d+)', 1) AS INTEGER) % 180 - 90 AS DOUBLE) AS lat,
  CAST(event_id % 3600 AS DOUBLE) / 10 - 180 AS lon FROM events WHERE event_type = 'click'""")
# --- streaming
cte("icleaned", ["messages"], f"""SELECT agency || '/' || CAST("index" AS VARCHAR) AS doc_id, agency, "index", date,
  {first_link('message')} AS first_link, {clean_text('message')} AS text FROM messages
  WHERE CAST(regexp_extract(agency, '(\\d+)$', 1) AS INTEGER) % 2 = 0""")
for _c in sentence_ctes("icleaned", "i"):
    cte(*_c)
INGEST = f"""SELECT m.agency, m."index", {_d('m.date')} AS date, {_d('CAST(m.date + INTERVAL 3 HOUR AS DATE)')} AS digest_date,
  {_part('m.date')} AS part, coalesce(s.headline, '') AS title, coalesce(s.summary, '') AS short_news,
  m.first_link, k.category FROM icleaned m JOIN kept k USING (doc_id) LEFT JOIN ishort s USING (doc_id) WHERE length(m.text) > 0"""
INB = "WITH " + NB.format(train_words=WORDS.format(x="text"), texts="icleaned")
q("stream_ingest", ["ishort", "icleaned"], f"""{INB}
SELECT agency, "index", date, digest_date, part, title, short_news FROM ({INGEST})""")
q("ingest_pipeline", ["ishort", "icleaned", "stored"], f"""{INB}
SELECT i.* FROM ({INGEST}) i LEFT JOIN (SELECT agency, "index" AS hw FROM (SELECT agency, "index",
  row_number() OVER (PARTITION BY agency ORDER BY date DESC, "index" DESC) AS rn FROM stored) WHERE rn = 1) h USING (agency)
WHERE i."index" > coalesce(h.hw, 0)""")
q("slot_assign", [], f"""SELECT event_id, {_d('CAST(ts + INTERVAL 3 HOUR AS DATE)')} AS digest_date,
  {_part('ts')} AS part FROM events""")
q("stream_slots", [], f"""SELECT {SLOT_OUT}, count(*) AS n_events FROM (SELECT {_slot_cols('ts')} FROM events) GROUP BY ALL""")
for _name in ("late_rows", "stream_late_counts"):
    q(_name, [], f"""SELECT {SLOT_OUT}, count(*) AS n_events, CAST(sum(CASE WHEN arrival_ts >=
    CAST(digest_date AS TIMESTAMP) + to_hours(CASE part WHEN 1 THEN 7 WHEN 2 THEN 12 WHEN 3 THEN 17 ELSE 21 END + 1)
    THEN 1 ELSE 0 END) AS BIGINT) AS n_late
  FROM (SELECT *, {_slot_cols('ts')}, ts + to_minutes(CAST((event_id % 7) * 30 AS BIGINT)) AS arrival_ts FROM events) GROUP BY ALL""")
q("stream_slot_close", [], f"""WITH e AS (SELECT ts, {_slot_cols('ts')}, date_trunc('hour', ts) + INTERVAL 1 HOUR AS hour_end FROM events),
  h AS (SELECT max(hour_end) AS horizon FROM e WHERE hour_end <= (SELECT max(ts) - INTERVAL 1 HOUR FROM e))
  SELECT {SLOT_OUT}, count(*) AS n_events FROM e, h WHERE
    CAST(digest_date AS TIMESTAMP) + to_hours(CASE part WHEN 1 THEN 7 WHEN 2 THEN 12 WHEN 3 THEN 17 ELSE 21 END) <= horizon
  GROUP BY digest_date, part""")
q("stream_dedup", ["messages"], f'SELECT DISTINCT agency, "index", {_d("date")} AS date FROM messages')
q("stream_high_water", ["messages"], """SELECT agency, "index" AS high_water FROM (SELECT agency, "index",
  row_number() OVER (PARTITION BY agency ORDER BY date DESC, "index" DESC) AS rn FROM messages) WHERE rn = 1""")
