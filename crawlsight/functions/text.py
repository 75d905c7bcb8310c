"""Column helpers for text: whitespace, entities, words, shingles, escaping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Named character references decoded in page text.
NAMED_ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0",
    "copy": "\u00a9", "reg": "\u00ae", "trade": "\u2122", "middot": "\u00b7", "bull": "\u2022",
    "hellip": "\u2026", "ndash": "\u2013", "mdash": "\u2014", "lsquo": "\u2018", "rsquo": "\u2019",
    "ldquo": "\u201c", "rdquo": "\u201d", "laquo": "\u00ab", "raquo": "\u00bb", "times": "\u00d7",
    "euro": "\u20ac", "pound": "\u00a3", "yen": "\u00a5", "cent": "\u00a2", "sect": "\u00a7",
    "para": "\u00b6", "deg": "\u00b0", "plusmn": "\u00b1", "frac12": "\u00bd", "frac14": "\u00bc",
    "agrave": "\u00e0", "aacute": "\u00e1", "acirc": "\u00e2", "auml": "\u00e4", "aring": "\u00e5",
    "aelig": "\u00e6", "ccedil": "\u00e7", "egrave": "\u00e8", "eacute": "\u00e9", "ecirc": "\u00ea",
    "euml": "\u00eb", "iacute": "\u00ed", "ntilde": "\u00f1", "oacute": "\u00f3", "ouml": "\u00f6",
    "oslash": "\u00f8", "uacute": "\u00fa", "uuml": "\u00fc", "szlig": "\u00df",
    "larr": "\u2190", "rarr": "\u2192", "zwnj": "\u200c", "shy": "\u00ad",
}

# The words left out of keyword density.
STOPWORDS = (
    "a an and are as at be by for from has have if in into is it its of on or that the this to was "
    "were will with you your"
).split()

# The characters a browser counts as whitespace.
# What is in Latin-1 stands one by one (Java tries those as one bit set); the rest is tried for other characters only.
WS_CLASS = r"[\t\n\x0b\f\r \xa0[[^\x00-\xff]&&[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]]]"
WS = WS_CLASS + "+"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once.

    Inside array lambdas Spark does not share common subexpressions; binding the value as a lambda
    variable does.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim_ws(c: Column) -> Column:
    """Trim every Unicode space, as a browser does (``trim`` alone only strips blanks).

    A run of spaces is entered at its first one only, so the search is linear; what is no space is passed after one test.
    """
    return F.regexp_replace(c, rf"^{WS_CLASS}++|{WS_CLASS}(?<!{WS_CLASS}{WS_CLASS}){WS_CLASS}*+$", "")


def collapse_ws(c: Column) -> Column:
    """Runs of whitespace become one blank, ends trimmed."""
    return F.trim(F.regexp_replace(c, WS, " "))


def blank_to_null(c: Column) -> Column:
    return F.nullif(trim_ws(c), F.lit(""))


def words(collapsed: Column) -> Column:
    """Words of already collapsed text."""
    return F.filter(F.split(collapsed, " "), lambda w: w != "")


def word_count(collapsed: Column) -> Column:
    """Number of words of already collapsed text: blanks + 1, without building the array."""
    return let_sql(
        collapsed, "w_t", "CASE WHEN w_t = '' THEN 0 ELSE length(w_t) - length(replace(w_t, ' ', '')) + 1 END"
    )


def let_sql(value: Column, var: str, body: str) -> Column:
    """As :func:`let`, with the body written as SQL over ``var``.

    The body reaches the JVM as one string, so building a plan with many of them stays quick.
    """
    return F.get(F.call_function("transform", F.array(value), F.expr(f"{var} -> {body}")), F.lit(0))


def _sql_text(v: str) -> str:
    return "'" + "".join(f"\\u{ord(ch):04x}" for ch in v) + "'"


ENTITY_TABLE = "map(" + ", ".join(f"'{k}', {_sql_text(v)}" for k, v in NAMED_ENTITIES.items()) + ")"


def decode_sql(var: str) -> str:
    """SQL that decodes named and numeric character references of the variable ``var``.

    One pass over the pieces between ampersands; text without an ampersand is returned as it is.
    """
    # at most seven significant digits; more, and numbers that are no character, are U+FFFD
    number = (
        "transform(array(CASE WHEN e_n RLIKE '^#[xX]0*[0-9a-fA-F]{1,7}$' THEN CAST(conv(substring(e_n, 3), 16, 10) AS BIGINT) "
        "WHEN e_n RLIKE '^#0*[0-9]{1,7}$' THEN CAST(substring(e_n, 2) AS BIGINT) ELSE 0L END), e_c -> CASE WHEN e_c = 0 OR e_c > 1114111 "
        "OR e_c BETWEEN 55296 AND 57343 THEN '\\ufffd' ELSE decode(unhex(lpad(hex(e_c), 8, '0')), 'UTF-32') END)[0]"
    )
    value = f"CASE WHEN e_n = '' THEN NULL WHEN startswith(e_n, '#') THEN {number} ELSE try_element_at({ENTITY_TABLE}, e_n) END"
    name = "regexp_extract(e_p, '^(#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);', 1)"
    piece = (
        f"transform(array({name}), e_n -> coalesce({value} || substring(e_p, length(e_n) + 2), '&' || e_p))[0]"
    )
    pieces = f"transform(array(split({var}, '&')), e_s -> e_s[0] || array_join(transform(slice(e_s, 2, size(e_s)), e_p -> {piece}), ''))[0]"
    return f"CASE WHEN instr({var}, '&') = 0 THEN {var} ELSE {pieces} END"


def decode_entities(c: Column) -> Column:
    """Named and numeric character references decoded."""
    return let_sql(c, "e_t", decode_sql("e_t"))


def shingles(words_of_text: Column, k: int = 5) -> Column:
    """Distinct runs of ``k`` words; a shorter text is one shingle, an empty one none."""
    return let(words_of_text, lambda ws: _shingles(ws, k))


def _shingles(ws: Column, k: int) -> Column:
    n = F.size(ws)
    runs = F.transform(
        F.sequence(F.lit(1), n - (k - 1)),
        lambda i: F.concat_ws(" ", *[F.element_at(ws, (i + j).cast("int")) for j in range(k)]),
    )
    return (
        F.when(n == 0, F.array().cast("array<string>"))
        .when(n < k, F.array(F.array_join(ws, " ")))
        .otherwise(F.array_distinct(runs))
    )


def _replace_all(c: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda acc, p: F.replace(acc, F.lit(p[0]), F.lit(p[1])), pairs, c)


def escape_xml(c: Column) -> Column:
    return _replace_all(
        c, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")]
    )


def escape_attr(c: Column) -> Column:
    return _replace_all(c, [("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")])


def escape_text(c: Column) -> Column:
    return _replace_all(c, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")])


def escape_tsv(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[\t\r\n]+", " ")


def escape_csv(c: Column) -> Column:
    c = F.coalesce(c, F.lit(""))
    return F.when(
        c.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    ).otherwise(c)


def count_of(n: Column, one: str, many: str | None = None) -> Column:
    """``3 pages`` / ``1 page``."""
    return F.concat(
        n.cast("string"), F.lit(" "), F.when(n == 1, F.lit(one)).otherwise(F.lit(many or one + "s"))
    )


def format_ms(ms: Column) -> Column:
    return F.when(ms >= 1000, F.concat(F.format_string("%.2f", ms / 1000), F.lit("s"))).otherwise(
        F.concat(F.round(ms).cast("long").cast("string"), F.lit("ms"))
    )


def redact(secret: Column) -> Column:
    return F.when(
        F.length(secret) > 12, F.concat(F.left(secret, F.lit(6)), F.lit("..."), F.right(secret, F.lit(4)))
    ).otherwise(F.lit("(redacted)"))


def slug_words(slug: Column) -> Column:
    """File or route name to words: extension off, hyphens and underscores to blanks."""
    s = F.regexp_replace(slug, r"(?i)\.[a-z0-9]+$", "")
    s = F.regexp_replace(s, r"[-_]+", " ")
    return F.trim(F.replace(s, F.lit("%20"), F.lit(" ")))


def capitalise_words(c: Column) -> Column:
    """Upper-case each word's first letter and keep the tail (``initcap`` would lower it)."""
    return F.array_join(
        F.transform(F.split(c, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))),
        " ",
    )


# Latin letters and the base letter they fold to.
_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďēęěğīįłńňōőŕřśšťūůűźżž"
_BASE = "aaaaaaceeeeiiiinooooouuuuyyaaaccdeeegiilnnoorrsstuuuzzz"


def slug_warnings(slug: Column) -> Column:
    """``gen_slug``: what is too long about a slug."""
    return F.concat_ws(";", F.when(F.length(slug) > 75, "length"), F.when(F.size(F.split(slug, "-")) > 8, "words"))


def slugify(title: Column) -> Column:
    s = F.translate(F.lower(title), _ACCENTED, _BASE)
    s = F.regexp_replace(s, r"[^a-z0-9\s-]", "")
    s = F.regexp_replace(F.trim(s), r"[\s_]+", "-")
    return F.regexp_replace(F.regexp_replace(s, "-+", "-"), "^-|-$", "")
