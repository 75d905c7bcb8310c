"""Column helpers for HTML: raw-text removal, tags, attributes, element text.

All patterns are linear: repeated groups are possessive, so a long page neither backtracks nor
overflows the regex stack.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlsight.functions.text import decode_entities, decode_sql, let, let_sql, trim_ws

ATTRS = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
SCRIPT_OPEN = rf"<script(?=[\s/>]){ATTRS}>"
STYLE_OPEN = rf"<style(?=[\s/>]){ATTRS}>"

# One alternative per token kind; every character of the page falls in exactly one token.
TOKEN = (
    rf"(?is)<!--.*?-->|<script\b[^>]*+>.*?</script\s*+>|<style\b[^>]*+>.*?</style\s*+>"
    rf"|<[a-z/!]{ATTRS}>|[^<]++|<"
)
ANY_TAG = rf"(?is)<[a-z/!]{ATTRS}>"


def drop_comments(html: Column) -> Column:
    """Comments go, except inside scripts and styles, where they are text."""
    return F.regexp_replace(
        html, rf"(?is)(?=<)(?:({SCRIPT_OPEN}.*?</script\s*+>|{STYLE_OPEN}.*?</style\s*+>)|<!--.*?-->)", "$1"
    )


def skeleton(html: Column) -> Column:
    """Page without comments and without the content of scripts and styles (the tags stay)."""
    return F.regexp_replace(
        html, rf"(?is)(?=<)(?:<!--.*?-->|({SCRIPT_OPEN}).*?</script\s*+>|({STYLE_OPEN}).*?</style\s*+>)", "$1$2"
    )


def head_of(html: Column) -> Column:
    """What a parser puts in <head>: everything before <body> or </head>."""
    return F.regexp_extract(html, r"(?is)^(.*?)(?:<body(?=[\s/>])|</head\s*>|$)", 1)


def body_of(html: Column) -> Column:
    """Everything after the <body> tag, else after </head>, else the page."""
    has_body = html.rlike(r"(?i)<body(?=[\s/>])")
    has_head = html.rlike(r"(?i)</head\s*>")
    return (
        F.when(has_body, F.regexp_replace(html, rf"(?is)^.*?<body(?=[\s/>]){ATTRS}>", ""))
        .when(has_head, F.regexp_replace(html, r"(?is)^.*?</head\s*+>", ""))
        .otherwise(html)
    )


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, ANY_TAG, "")


def text_of(html: Column) -> Column:
    """Text of a fragment: tags out, character references decoded."""
    return decode_entities(strip_tags(html))


def tags(html: Column, names: str) -> Column:
    """Opening tags named ``a|b|c`` in document order."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<(?:{names})(?=[\s/>]){ATTRS}>"), F.lit(0))


def elements(html: Column, names: str) -> Column:
    """Elements that cannot nest in themselves, opening tag to end tag (end tag may be missing)."""
    return F.regexp_extract_all(
        html,
        F.lit(rf"(?is)<({names})(?=[\s/>]){ATTRS}>(?:(?!</?\1(?=[\s/>])).)*+(?:</\1\s*+>)?"),
        F.lit(0),
    )


def count_tags(html: Column, names: str) -> Column:
    return F.regexp_count(html, F.lit(rf"(?is)<(?:{names})(?=[\s/>])"))


def guarded(lowered: Column, needle: str, then: Column, otherwise: Column) -> Column:
    """Run a regex over a page only when a plain substring search says it can match."""
    return F.when(lowered.contains(needle), then).otherwise(otherwise)


def _attr_pattern(name: str) -> str:
    value = r"""(?:"[^"]*+"|'[^']*+'|[^\s>"']++)"""
    return (
        rf"(?is)^<[a-z][^\s/>]*+(?:[\s/]++(?!{name}[\s=/>])[^\s=>/]++(?:\s*+=\s*+{value})?+)*+"
        rf"[\s/]++{name}(?:\s*+=\s*+({value})|(?=[\s/>]))"
    )


def has_attr(tag: Column, name: str) -> Column:
    return tag.rlike(_attr_pattern(name))


_UNQUOTED = "CASE WHEN a_r RLIKE '^[\"\\']' THEN substring(a_r, 2, length(a_r) - 2) ELSE a_r END"


def attr(tag: Column, name: str, decode: bool = True) -> Column:
    """Attribute value of an opening tag, '' when it is missing or empty; the first one counts."""
    raw = F.regexp_extract(tag, _attr_pattern(name), 1)
    body = f"transform(array({_UNQUOTED}), a_v -> {decode_sql('a_v')})[0]" if decode else _UNQUOTED
    return let_sql(raw, "a_r", body)


def attr_or_null(tag: Column, name: str, decode: bool = True) -> Column:
    """As :func:`attr`, but NULL when the attribute is missing."""
    return F.when(has_attr(tag, name), attr(tag, name, decode))


def tag_name(tag: Column) -> Column:
    return F.lower(F.regexp_extract(tag, r"(?i)^</?([a-z][a-z0-9:-]*)", 1))


def open_tag(element: Column) -> Column:
    return F.regexp_extract(element, rf"(?is)^<[a-z]{ATTRS}>", 0)


def element_text(element: Column) -> Column:
    return trim_ws(text_of(element))


def nesting(html: Column, name: str) -> Column:
    """How deep elements of one name stand in each other."""
    tags = F.regexp_extract_all(html, F.lit(rf"(?i)</?{name}(?=[\s/>])"), F.lit(0))
    step = lambda a, t: F.when(t.startswith("</"), F.struct(F.greatest(F.lit(0), a["now"] - 1).alias("now"), a["most"].alias("most"))).otherwise(
        F.struct((a["now"] + 1).alias("now"), F.greatest(a["most"], a["now"] + 1).alias("most")))
    return F.aggregate(tags, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step)["most"]


def without(html: Column, name: str) -> Column:
    """Remove elements of one name with their content; innermost first, as often as they are nested."""
    innermost = rf"(?is)<{name}(?=[\s/>]){ATTRS}>(?:(?!</?{name}(?=[\s/>])).)*+</{name}\s*+>"

    def cut(page: Column) -> Column:
        rounds = let(nesting(page, name), lambda n: F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")))
        shorter = F.aggregate(rounds, page, lambda a, _: F.regexp_replace(a, innermost, ""))
        return F.when(F.lower(page).contains("<" + name), shorter).otherwise(page)

    return let(html, cut)  # the page stands in it once, so removals may follow each other
