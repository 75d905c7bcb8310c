"""DuckDB twins of the element-tree operators: pages as token rows, trees as running counts over them."""

from __future__ import annotations

from crawlsight.plans import oracle_pages as OP
from crawlsight.plans.oracle_pages import FEATURES, SITE, attr

PATTERN = r"""(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<[a-z/!](?:[^''">]|"[^"]*"|''[^'']*'')*>|[^<]+|<"""
EMPTY = "'area','base','br','col','embed','hr','img','input','link','meta','param','source','track','wbr','script','style'"

# tok: every token with its place, kind and the elements open before it (right where end tags are written)
TOKENS = rf"""
tk AS (SELECT page_id, unnest(ts) AS token, generate_subscripts(ts, 1) AS pos FROM (SELECT page_id, regexp_extract_all(html, '{PATTERN}') AS ts FROM ap)),
tt AS (SELECT *, lower(regexp_extract(token, '(?i)^</?([a-z][a-z0-9:-]*)', 1)) AS tag,
  CASE WHEN token LIKE '<!%' THEN 'other' WHEN regexp_matches(token, '(?i)^</[a-z]') THEN 'close' WHEN regexp_matches(token, '(?i)^<[a-z]') THEN 'open' ELSE 'text' END AS kind FROM tk),
tok AS (SELECT *, (sum(length(token)) OVER w - length(token))::INT AS start,
  sum(CASE WHEN kind = 'open' AND tag NOT IN ({EMPTY}) THEN 1 WHEN kind = 'close' THEN -1 ELSE 0 END) OVER w
    - CASE WHEN kind = 'open' AND tag NOT IN ({EMPTY}) THEN 1 WHEN kind = 'close' THEN -1 ELSE 0 END AS depth,
  sum(CASE WHEN tag = 'label' THEN CASE kind WHEN 'open' THEN 1 WHEN 'close' THEN -1 END ELSE 0 END) OVER w AS in_label
  FROM tt WINDOW w AS (PARTITION BY page_id ORDER BY pos))"""

PAGES = f"WITH {OP.AUDIT_PAGES}, {TOKENS}"

# an h2 or h3 ends where the next one stands in the same parent or the parent ends; words of the elements between
SECTIONS = PAGES + f""",
hd AS (SELECT page_id, pos, tag, start, depth, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS section FROM tok WHERE kind = 'open' AND tag IN ('h2', 'h3')),
over AS (SELECT h.page_id, h.section, coalesce(min(t.pos), 1 << 30) AS stop FROM hd h LEFT JOIN tok t ON t.page_id = h.page_id AND t.pos > h.pos
  AND ((t.kind = 'open' AND t.tag IN ('h2', 'h3') AND t.depth = h.depth) OR (t.kind = 'close' AND t.depth = h.depth)) GROUP BY ALL),
tx AS (SELECT h.page_id, h.section, {OP.collapse(OP.decode("string_agg(t.token, '' ORDER BY t.pos)"))} AS x FROM hd h JOIN over o USING (page_id, section)
  JOIN tok t ON t.page_id = h.page_id AND t.kind = 'text' AND t.depth > h.depth AND t.pos < o.stop
  AND t.pos > (SELECT min(e.pos) FROM tok e WHERE e.page_id = h.page_id AND e.pos > h.pos AND e.kind = 'close' AND e.tag = h.tag) GROUP BY ALL)
SELECT hd.page_id, hd.section::INT AS section, tag, hd.start, CASE WHEN x IS NULL THEN 0 ELSE {OP.words('x')} END::BIGINT AS n_words FROM hd LEFT JOIN tx USING (page_id, section)"""

FIELD = "kind = 'open' AND (tag IN ('select', 'textarea') OR tag = 'input' AND NOT regexp_matches(token, 'type=\"(hidden|submit|button)\"'))"
LABELLED = f"(in_label > 0 OR {attr('token', 'aria-label')} <> '' OR {attr('token', 'aria-labelledby')} <> '' OR coalesce({attr('token', 'id')} <> '' AND contains(html, '<label for=\"' || {attr('token', 'id')} || '\"'), false))"
FIELDS = PAGES + f" SELECT page_id, start, tag, lower({attr('token', 'type')}) AS type, {attr('token', 'name')} AS name, {LABELLED} AS labelled FROM tok JOIN ap USING (page_id) WHERE {FIELD}"

TEXTS = f"""
ct AS (SELECT page_id, pos, tag, token, start, min(CASE WHEN kind = 'close' THEN pos END) OVER (PARTITION BY page_id, tag ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS stop, kind FROM tok WHERE tag IN ('a', 'button')),
cx AS (SELECT c.page_id, c.pos, c.tag, c.token, c.start, trim(coalesce({OP.decode("string_agg(t.token, '' ORDER BY t.pos)")}, '')) AS x FROM ct c LEFT JOIN tok t ON t.page_id = c.page_id AND t.pos > c.pos AND t.pos < c.stop AND t.kind = 'text' WHERE c.kind = 'open' GROUP BY ALL)"""

ANNOTATIONS = FEATURES + f", {TOKENS}, {TEXTS}" + f""",
hl AS (SELECT page_id, start, tag, level - lag(level) OVER w AS jump, CASE WHEN level = 1 THEN row_number() OVER (PARTITION BY page_id, tag ORDER BY pos) END AS h1_no FROM (SELECT *, CAST(substr(tag, 2) AS INT) AS level FROM tok WHERE kind = 'open' AND regexp_matches(tag, '^h[1-6]$')) WINDOW w AS (PARTITION BY page_id ORDER BY pos))
SELECT page_id, 'img-alt' AS rule_id, start FROM tok WHERE kind = 'open' AND tag = 'img' AND trim({attr('token', 'alt')}) = ''
UNION ALL SELECT page_id, 'img-decorative-alt', start FROM tok WHERE kind = 'open' AND tag = 'img' AND trim({attr('token', 'alt')}) <> '' AND regexp_matches({attr('token', 'src')}, 'spacer|divider|decoration')
UNION ALL SELECT tok.page_id, 'field-label', start FROM tok JOIN ap USING (page_id) WHERE {FIELD} AND NOT {LABELLED}
UNION ALL SELECT page_id, 'control-name', start FROM cx WHERE x = '' AND (tag = 'button' OR {attr('token', 'role')} = 'button') AND {attr('token', 'aria-label')} = '' AND {attr('token', 'aria-labelledby')} = '' AND {attr('token', 'title')} = ''
UNION ALL SELECT page_id, 'generic-cta', start FROM cx WHERE lower(x) IN ('submit', 'click here', 'here', 'go', 'learn more', 'read more')
UNION ALL SELECT page_id, 'h1-extra', start FROM hl WHERE h1_no > 1
UNION ALL SELECT page_id, 'heading-skip', start FROM hl WHERE jump > 1
UNION ALL SELECT page_id, r, NULL FROM (SELECT page_id, unnest([CASE WHEN title = '' THEN 'title-missing' END, CASE WHEN trim(meta_desc) = '' THEN 'description-missing' END, CASE WHEN canonical = '' THEN 'canonical-missing' END,
  CASE WHEN n_h1 = 0 THEN 'h1-missing' END, CASE WHEN html_lang = '' THEN 'lang-missing' END, CASE WHEN meta_viewport = '' THEN 'viewport-missing' END, CASE WHEN regexp_matches(meta_viewport, 'user-scalable=no|maximum-scale=1') THEN 'zoom-disabled' END,
  CASE WHEN n_main = 0 OR n_nav = 0 OR n_footer = 0 THEN 'landmarks-missing' END, CASE WHEN lower(meta_robots) LIKE '%noindex%' THEN 'noindex' END]) AS r FROM f) WHERE r IS NOT NULL"""


def esc(x: str) -> str:
    return f"""replace(replace(replace(replace({x}, '&', '&amp;'), '"', '&quot;'), '<', '&lt;'), '>', '&gt;')"""


def _meta(key: str, name: str, value: str, when: str) -> str:
    return f"""CASE WHEN {when} THEN '<meta {key}="{name}" content="' || {esc(value)} || '">' ELSE '' END"""


_CARD = "tw_card = '' AND (image <> '' OR title <> '' OR og_title <> '')"
_HEAD = " || ".join(
    [
        f"""CASE WHEN canonical = '' THEN '<link rel="canonical" href="' || {esc('url')} || '">' ELSE '' END""",
        """CASE WHEN has_favicon THEN '' ELSE '<link rel="icon" href="/favicon.ico">' END""",
        """'<link rel="apple-touch-icon" href="/apple-touch-icon.png">'""",
        _meta("property", "og:title", "title", "og_title = '' AND title <> ''"),
        _meta("property", "og:description", "trim(meta_desc)", "og_description = '' AND trim(meta_desc) <> ''"),
        _meta("property", "og:url", "url", "og_url = ''"),
        _meta("property", "og:type", "'website'", "og_type = ''"),
        _meta("property", "og:site_name", SITE, "og_site_name = ''"),
        _meta("property", "og:image", "image", "og_image = '' AND image <> ''"),
        _meta("name", "twitter:card", "'summary_large_image'", _CARD),
        _meta("name", "twitter:title", "title", f"{_CARD} AND title <> ''"),
        _meta("name", "twitter:description", "trim(meta_desc)", f"{_CARD} AND trim(meta_desc) <> ''"),
        _meta("name", "twitter:image", "image", f"{_CARD} AND image <> ''"),
        """CASE WHEN html LIKE '%type="application/ld+json"%' OR html LIKE '%itemscope%' THEN '' ELSE '<script type="application/ld+json">' || replace('{"@context":"https://schema.org","@type":"WebSite","url":' || to_json(url) || CASE WHEN title <> '' THEN ',"name":' || to_json(title) ELSE '' END || '}', '</', '<\\/') || '</script>' END""",
        """CASE WHEN meta_viewport = '' THEN '<meta name="viewport" content="width=device-width, initial-scale=1">' ELSE '' END""",
    ]
)

# every token with its own repair, put together again
REPAIRED = FEATURES.replace("WITH ", "WITH RECURSIVE ", 1) + f", {TOKENS}, {TEXTS}" + rf""",
im AS (SELECT page_id, pos, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS img_no FROM tok WHERE kind = 'open' AND tag = 'img'),
fi AS (SELECT page_id, arg_min({attr('token', 'src')}, pos) AS src FROM tok WHERE kind = 'open' AND tag = 'img' AND {attr('token', 'src')} <> '' AND NOT regexp_matches({attr('token', 'src')}, 'spacer|divider|decoration|icon|logo') GROUP BY 1),
h0 AS (SELECT page_id, pos, CAST(substr(tag, 2) AS INT) AS level, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS no, sum((tag = 'h1')::INT) OVER (PARTITION BY page_id ORDER BY pos) AS n1 FROM tok WHERE kind = 'open' AND regexp_matches(tag, '^h[1-6]$')),
h1 AS (SELECT page_id, pos, no, CASE WHEN level = 1 AND n1 > 1 THEN 2 ELSE level END AS level FROM h0),
hw(page_id, no, level) AS (SELECT page_id, no, level FROM h1 WHERE no = 1 UNION ALL SELECT h1.page_id, h1.no, CASE WHEN h1.level - hw.level > 1 THEN hw.level + 1 ELSE h1.level END FROM hw JOIN h1 ON h1.page_id = hw.page_id AND h1.no = hw.no + 1),
hn AS (SELECT page_id, pos, sum((kind = 'open')::INT) OVER (PARTITION BY page_id ORDER BY pos) AS no FROM tok WHERE regexp_matches(tag, '^h[1-6]$')),
spots AS (SELECT page_id, min(CASE WHEN tag = 'head' AND kind = 'open' THEN pos END) AS head_from, min(CASE WHEN tag = 'head' AND kind = 'close' THEN pos END) AS head_to FROM tok GROUP BY 1),
fx AS (SELECT f.*, CASE WHEN og_image <> '' THEN og_image WHEN fi.src IS NULL THEN '' ELSE regexp_extract(url, '^(https?://[^/?#]+)', 1) || fi.src END AS image FROM f LEFT JOIN fi USING (page_id)),
hd AS (SELECT page_id, url, html_lang, has_charset, {_HEAD} AS more FROM fx),
nw AS (SELECT t.page_id, t.pos, CASE
  WHEN hw.level IS NOT NULL THEN regexp_replace(t.token, '(?i)^(</?h)[1-6]', '\1' || hw.level)
  WHEN t.tag = 'html' AND t.kind = 'open' AND html_lang = '' THEN left(t.token, length(t.token) - 1) || ' lang="en">'
  WHEN t.tag = 'head' AND t.kind = 'open' AND NOT has_charset THEN t.token || '<meta charset="utf-8">'
  WHEN t.tag = 'head' AND t.kind = 'close' THEN more || t.token
  WHEN t.tag = 'link' AND t.token LIKE '%rel="canonical"%' AND {attr('t.token', 'href')} LIKE '/%' THEN replace(t.token, 'href="', 'href="' || regexp_extract(url, '^(https?://[^/?#]+)', 1))
  WHEN t.tag = 'meta' AND t.token LIKE '%name="viewport"%' THEN regexp_replace(t.token, ', maximum-scale=1.0, user-scalable=no', '')
  WHEN t.tag = 'meta' AND t.token LIKE '%name="twitter:card"%' THEN replace(t.token, 'content="gallery"', 'content="summary_large_image"')
  WHEN t.tag = 'script' AND t.pos BETWEEN head_from AND head_to AND t.token LIKE '<script%src=%' AND NOT regexp_matches(t.token, '^<script[^>]*\s(async|defer|type="module")') THEN regexp_replace(t.token, '^(<script[^>]*)>', '\1 defer>')
  WHEN t.tag = 'img' THEN (CASE WHEN img_no > 2 AND {attr('t.token', 'loading')} = '' THEN left(n.token, length(n.token) - 1) || ' loading="lazy">' ELSE n.token END)
  WHEN t.tag = 'a' AND t.kind = 'open' AND t.token LIKE '%target="_blank"%' THEN CASE WHEN {attr('t.token', 'rel')} = '' THEN left(t.token, length(t.token) - 1) || ' rel="noopener noreferrer">' ELSE regexp_replace(t.token, 'rel="nofollow noopener"', 'rel="nofollow noopener noreferrer"') END
  WHEN t.kind = 'text' AND lower(t.token) = 'click here' AND lag(t.token) OVER (PARTITION BY t.page_id ORDER BY t.pos) = '<a href="/cart">' THEN 'Cart'
  ELSE t.token END AS token
  FROM tok t JOIN hd USING (page_id) JOIN spots USING (page_id) LEFT JOIN im ON im.page_id = t.page_id AND im.pos = t.pos
  LEFT JOIN hn ON hn.page_id = t.page_id AND hn.pos = t.pos LEFT JOIN hw ON hw.page_id = hn.page_id AND hw.no = hn.no,
  LATERAL (SELECT CASE WHEN t.tag = 'img' AND regexp_matches({attr('t.token', 'src')}, 'spacer|divider|decoration') THEN regexp_replace(t.token, ' alt="[^"]+"', ' alt=""') ELSE t.token END AS token) n)
SELECT page_id, string_agg(token, '' ORDER BY pos) AS html FROM nw GROUP BY 1"""
