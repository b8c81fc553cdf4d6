"""Text scalars as JVM-side column expressions (no Python UDFs).

Every function takes and returns a ``Column`` so it stays inside whole-stage
codegen and can be used in batch and streaming plans alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Boilerplate labels that the ingest replaces with a newline, literal match,
# applied in this order (values must equal the reference's for equal output).
BOILERPLATE_LABELS: tuple[str, ...] = (
    "ДАННОЕ СООБЩЕНИЕ (МАТЕРИАЛ) СОЗДАНО И (ИЛИ) РАСПРОСТРАНЕНО ИНОСТРАННЫМ СРЕДСТВОМ МАССОВОЙ ИНФОРМАЦИИ, "
    "ВЫПОЛНЯЮЩИМ ФУНКЦИИ ИНОСТРАННОГО АГЕНТА, И (ИЛИ) РОССИЙСКИМ ЮРИДИЧЕСКИМ ЛИЦОМ, ВЫПОЛНЯЮЩИМ ФУНКЦИИ "
    "ИНОСТРАННОГО АГЕНТА",
    "  Поддержите The Village подпиской https://redefine.media/about (подробная инструкция здесь)",
    "*Власти считают иноагентом  ",
)
# Link prefix that does not count as a first link.
CHAT_LINK_PREFIX = "tg://resolve?domain="
# Per-article channel link.
CHANNEL_LINK_BASE = "https://t.me/"
# Named HTML entities decoded by html_to_text, after the numeric ones; "&amp;"
# must stay last so that "&amp;lt;" becomes "&lt;" and not "<".
HTML_ENTITIES: tuple[tuple[str, str], ...] = (
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&apos;", "'"),
    ("&nbsp;", "\u00a0"),
    ("&middot;", "·"),
    ("&copy;", "©"),
    ("&reg;", "®"),
    ("&trade;", "™"),
    ("&laquo;", "«"),
    ("&raquo;", "»"),
    ("&ldquo;", "\u201c"),
    ("&rdquo;", "\u201d"),
    ("&bdquo;", "\u201e"),
    ("&lsquo;", "\u2018"),
    ("&rsquo;", "\u2019"),
    ("&ndash;", "–"),
    ("&mdash;", "—"),
    ("&minus;", "−"),
    ("&hellip;", "…"),
    ("&bull;", "•"),
    ("&deg;", "°"),
    ("&sect;", "§"),
    ("&para;", "¶"),
    ("&times;", "×"),
    ("&frac12;", "½"),
    ("&euro;", "€"),
    ("&pound;", "£"),
    ("&amp;", "&"),
)
# ----------------------------------------------------------------------------

# Whitespace in the Python ``str.split()`` sense (Unicode White_Space).
WHITESPACE_RUN = r"(?U)\s+"
# Non-content markup removed before anything else is read from a page.
_NON_CONTENT = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
_FIRST_ANCHOR = r"(?i)(<a(?:\s[^>]*)?>)"
_HREF_VALUE = r"""(?i)\shref\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""


def _lit(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# A numeric entity, decimal or hexadecimal; others than these stay as they are.
NUMERIC_ENTITY = r"&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"


def _code_point(entity: Column) -> Column:
    """The character of one numeric entity, the entity itself if there is
    none. UTF-32 bytes decode to it, which Spark's ``chr`` (Latin-1) cannot."""
    hexadecimal = F.lower(F.substring(entity, 3, 1)) == "x"
    digits = F.regexp_extract(entity, r"([0-9a-fA-F]+);$", 1)
    code = F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(digits).cast("int")
    valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(code == 38, "&amp;").when(valid, char).otherwise(entity)  # "&" is decoded last


def decode_numeric(col: Column | str) -> Column:
    """Numeric entities, from left to right: the text between them joined with
    their characters. Texts without one are left alone."""
    text = _lit(col)
    between = F.split(text, NUMERIC_ENTITY)
    found = F.transform(F.regexp_extract_all(text, F.lit(NUMERIC_ENTITY), 0), _code_point)
    joined = F.array_join(F.zip_with(between, F.concat(found, F.array(F.lit(""))), lambda t, e: F.concat(t, e)), "")
    return F.when(text.rlike(NUMERIC_ENTITY), joined).otherwise(text)


def decode_entities(col: Column | str) -> Column:
    out = decode_numeric(col)
    for entity, char in HTML_ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def strip_non_content(html: Column | str) -> Column:
    return F.regexp_replace(_lit(html), _NON_CONTENT, "")


def first_link(html: Column | str) -> Column:
    """H1: href of the first <a> tag; NULL when there is no anchor, the first
    anchor has no href (the next anchor is *not* consulted), the href is empty,
    or it is a chat-resolve link."""
    tag = F.regexp_extract(strip_non_content(html), _FIRST_ANCHOR, 1)
    raw = F.regexp_extract(tag, _HREF_VALUE, 1)
    unquoted = F.regexp_replace(raw, r"""^["']|["']$""", "")
    href = decode_entities(unquoted)
    return (F.when((href == "") | href.startswith(CHAT_LINK_PREFIX), F.lit(None).cast("string"))
            .otherwise(href))


def html_to_text(html: Column | str) -> Column:
    """H2: text of all nodes: drop comments/script/style, drop tags, decode
    numeric entities and a fixed list of named ones."""
    no_tags = F.regexp_replace(strip_non_content(html), r"<[^>]*>", "")
    return decode_entities(no_tags)


def flatten_space(s: Column | str) -> Column:
    """H3: no-break space and newline become a blank."""
    return F.replace(F.replace(_lit(s), F.lit("\u00a0"), F.lit(" ")), F.lit("\n"), F.lit(" "))


def strip_labels(s: Column | str, labels: Sequence[str] = BOILERPLATE_LABELS) -> Column:
    """H4: each boilerplate label becomes a newline (literal, in order)."""
    out = _lit(s)
    for label in labels:
        out = F.replace(out, F.lit(label), F.lit("\n"))
    return out


def clean_text(html: Column | str, labels: Sequence[str] = BOILERPLATE_LABELS) -> Column:
    """H2 + H3 + H4 as applied by the ingest."""
    return strip_labels(flatten_space(html_to_text(html)), labels)


def article_links(first_link_col: Column | str, agency: Column | str, index: Column | str) -> Column:
    """H5: channel link of the post, preceded by the first link when present."""
    own = F.concat(F.lit(CHANNEL_LINK_BASE), _lit(agency), F.lit("/"), _lit(index).cast("string"))
    return F.concat_ws(" ", _lit(first_link_col), own)


def clean_word(w: Column | str, letters: str = r"\p{L}") -> Column:
    """H6 + H8: keep letters and hyphen, trim hyphens, lower-case.
    ``letters`` is the kept alphabet as a regex class body."""
    kept = F.regexp_replace(_lit(w), f"[^{letters}-]", "")
    return F.lower(F.btrim(kept, F.lit("-")))


def tokenise(s: Column | str) -> Column:
    """H7: split on any (Unicode) whitespace run; empty ends are removed."""
    return F.filter(F.split(_lit(s), WHITESPACE_RUN), lambda t: t != "")


def label_suffix(s: Column | str) -> Column:
    """H9: text after the last '__'."""
    return F.element_at(F.split(_lit(s), "__"), -1)


def drop_title_prefix(summary: Column | str, title: Column | str) -> Column:
    """Remove ``title + '. '`` from the summary."""
    return F.replace(_lit(summary), F.concat(_lit(title), F.lit(". ")), F.lit(""))


def capitalise(s: Column | str) -> Column:
    """First character upper, the rest lower (not initcap)."""
    c = _lit(s)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))

