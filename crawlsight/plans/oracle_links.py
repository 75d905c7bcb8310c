"""DuckDB twins of the link, image, URL and duplicate operators."""

from __future__ import annotations

from crawlsight.functions.text import STOPWORDS
from crawlsight.plans.oracle_pages import AUDIT_PAGES, NC, SEVERITY, SKEL, attr, collapse, decode, strip, words

ENC = r"array_to_string(list_transform(regexp_extract_all({u}, '[!-~]+|[^!-~]+'), lambda x: CASE WHEN regexp_matches(x, '^[!-~]') THEN x ELSE replace(url_encode(x), '+', '%20') END), '')"


def enc(u: str) -> str:
    return ENC.replace("{u}", u)


HOST = r"lower(regexp_extract({u}, '^[a-z]+://([^/?#:]+)', 1))"


def host(u: str) -> str:
    return HOST.replace("{u}", u)


ORIGIN = r"regexp_extract(url, '^(https?://[^/?#]+)', 1)"
ROOTED = r"CASE WHEN regexp_matches(u, '^https?://[^/?#]+$') THEN u || '/' WHEN regexp_matches(u, '^https?://[^/?#]+[?#]') THEN regexp_replace(u, '^(https?://[^/?#]+)', '\1/') ELSE u END"


def resolve(href: str) -> str:
    """Resolution for the link shapes that occur: absolute, //host, /path and ../path."""
    return (
        f"CASE WHEN regexp_matches({href}, '^https?://[^ ]+$') THEN {href} WHEN {href} LIKE '//%' THEN regexp_extract(url, '^(https?:)', 1) || {href} "
        f"WHEN {href} LIKE '/%' THEN {ORIGIN} || {href} WHEN {href} LIKE '../%' THEN {ORIGIN} || substr({href}, 3) END"
    )


LINKS = rf"""
{AUDIT_PAGES},
l0 AS (SELECT page_id, url, unnest(a) AS el, generate_subscripts(a, 1) - 1 AS pos
       FROM (SELECT page_id, url, regexp_extract_all({SKEL}, '(?is)<a(?:\s[^>]*)?>.*?</a>') AS a FROM ap)),
l1 AS (SELECT page_id, url, pos, {attr("regexp_extract(el, '^<a[^>]*>')", 'href')} AS href, trim({strip('el')}) AS text,
       lower({attr("regexp_extract(el, '^<a[^>]*>')", 'rel')}) AS rel, {attr("regexp_extract(el, '^<a[^>]*>')", 'target')} AS target,
       trim({attr("regexp_extract(el, '<img[^>]*>')", 'alt')}) AS img_alt FROM l0),
l2 AS (SELECT *, CASE WHEN trim(href) = '' THEN 'empty' WHEN href LIKE 'javascript:%' THEN 'javascript'
         WHEN regexp_matches(href, '^(mailto|tel|sms):') THEN 'contact' WHEN href LIKE '#%' THEN 'anchor'
         WHEN regexp_matches(href, '^[a-z]* [a-z]*:') THEN 'malformed' ELSE 'link' END AS kind,
       {resolve('href')} AS u FROM l1),
links AS (SELECT * EXCLUDE (u), CASE WHEN kind = 'link' THEN {enc(ROOTED)} END AS resolved_url,
       kind = 'link' AND {host('u')} <> {host('url')} AS is_external, coalesce(nullif(text, ''), img_alt) = '' AS has_no_text,
       target = '_blank' AND NOT regexp_matches(rel, 'noopener|noreferrer') AS missing_noopener FROM l2)"""

# Status of a checked URL, derived from its length.
STATUS = (
    "status AS (SELECT resolved_url, length(resolved_url) % 7 <> 0 AS ok, CASE WHEN length(resolved_url) % 7 <> 0 THEN 200 "
    "WHEN length(resolved_url) % 14 = 0 THEN 404 END AS status_code FROM (SELECT DISTINCT resolved_url FROM links WHERE kind = 'link'))"
)

EXT_LINKS = f"WITH {LINKS} SELECT page_id, pos::INT AS pos, href, text, rel, nullif(target, '') AS target, img_alt FROM links"
LINK_CLASS = f"WITH {LINKS} SELECT page_id, pos::INT AS pos, kind, resolved_url, is_external, has_no_text, missing_noopener FROM links"
LINK_COUNTS = f"""WITH {LINKS} SELECT page_id, count(*) AS n_links, count_if(kind = 'link')::BIGINT AS n_checkable, count_if(is_external)::BIGINT AS n_external,
  (count_if(kind = 'link') - count_if(is_external))::BIGINT AS n_internal FROM links GROUP BY page_id"""
DUP_LINKS = f"""WITH {LINKS}, r AS (SELECT *, row_number() OVER (PARTITION BY page_id, resolved_url ORDER BY pos) rn FROM links WHERE kind = 'link')
SELECT page_id, resolved_url, count(*) AS n, array_to_string(list(CASE WHEN text = '' THEN '(no text)' ELSE text END ORDER BY pos) FILTER (rn <= 3), ' | ') AS sample_texts
FROM r GROUP BY ALL HAVING count(*) > 1"""
LINK_REFS = f"""WITH {LINKS} SELECT resolved_url, count(DISTINCT url) AS n_pages, bool_or(is_external) AS is_external, min(nullif(text, '')) AS sample_text
FROM links WHERE kind = 'link' GROUP BY resolved_url"""
TOPK_LINKS = LINK_REFS + " ORDER BY n_pages DESC, resolved_url LIMIT 500"
LINK_STATUS = f"WITH {LINKS}, {STATUS} SELECT page_id, pos::INT AS pos, resolved_url, ok, status_code FROM links JOIN status USING (resolved_url) WHERE kind = 'link'"
AFFECTED = f"""WITH {LINKS}, {STATUS}, d AS (SELECT DISTINCT resolved_url, url FROM links JOIN status USING (resolved_url) WHERE kind = 'link' AND NOT ok)
SELECT * FROM (SELECT resolved_url, url, row_number() OVER (PARTITION BY resolved_url ORDER BY url) AS page_no FROM d) WHERE page_no <= 25"""
DISTINCT_URLS = f"WITH {LINKS} SELECT DISTINCT resolved_url FROM links WHERE kind = 'link'"


def _finding(rule: str, weight: int, cond: str, passed: bool = False) -> str:
    return f"SELECT page_id, '{rule}' AS rule_id, {str(passed).lower()} AS passed, {weight} AS weight, n::BIGINT AS n FROM (SELECT *, {cond[0]} AS n FROM pf) WHERE {cond[1]}"


AUDIT_LINKS = f"""WITH {LINKS}, {STATUS},
u AS (SELECT page_id, resolved_url, count(*) n FROM links WHERE kind = 'link' GROUP BY ALL),
u2 AS (SELECT page_id, count_if(n > 1) d, count_if(NOT ok) b, count_if(ok IS NOT NULL) ch FROM u LEFT JOIN status USING (resolved_url) GROUP BY page_id),
l3 AS (SELECT page_id, count_if(kind = 'empty') e, count_if(kind = 'javascript') j, count_if(kind = 'malformed') m, count_if(has_no_text) t, count_if(missing_noopener) o, count_if(is_external) x FROM links GROUP BY page_id),
pf AS (SELECT page_id, coalesce(d, 0) d, coalesce(b, 0) b, coalesce(ch, 0) ch, coalesce(e, 0) e, coalesce(j, 0) j, coalesce(m, 0) m, coalesce(t, 0) t, coalesce(o, 0) o, coalesce(x, 0) x
  FROM ap LEFT JOIN u2 USING (page_id) LEFT JOIN l3 USING (page_id)),
fx AS ({' UNION ALL '.join(_finding(r, w, (k, k + (' > 50' if k == 'x' else ' > 0'))) for r, w, k in (
    ('broken-links', 12, 'b'), ('duplicate-links', 2, 'd'), ('empty-hrefs', 3, 'e'), ('javascript-links', 4, 'j'), ('malformed-hrefs', 3, 'm'),
    ('links-without-text', 5, 't'), ('missing-rel-noopener', 4, 'o'), ('too-many-external-links', 3, 'x')))}
  UNION ALL {_finding('broken-links', 0, ('NULL', 'ch > 0 AND b = 0'), True)}
  UNION ALL {_finding('link-hygiene', 0, ('NULL', 'd + b + e + j + m + t + o = 0 AND x <= 50'), True)})
SELECT page_id, rule_id, passed, weight, n, {SEVERITY} AS severity FROM fx"""

AUDIT_LINKS_SITE = f"""WITH {LINKS}, {STATUS}, refs AS (SELECT resolved_url, count(DISTINCT url) n, bool_or(is_external) x FROM links WHERE kind = 'link' GROUP BY ALL),
ck AS (SELECT * FROM refs JOIN status USING (resolved_url)),
t AS (SELECT count_if(NOT ok AND NOT x)::BIGINT bi, count_if(NOT ok AND x)::BIGINT be, count(*) nc FROM ck), a AS (SELECT count(*) nu FROM refs)
SELECT 'broken-internal-links' AS rule_id, bi = 0 AS passed, CASE WHEN bi > 0 THEN 12 ELSE 0 END AS weight, CASE WHEN bi > 0 THEN bi END AS n FROM t
UNION ALL SELECT 'broken-external-links', be = 0, CASE WHEN be > 0 THEN 4 ELSE 0 END, CASE WHEN be > 0 THEN be END FROM t
UNION ALL SELECT 'link-check-coverage', true, 0, nc FROM t, a WHERE nc < nu"""

# --- images: expected rows straight from the columns of the catalogue ---------------------------------

IMAGES = f"""
{AUDIT_PAGES},
im AS (SELECT page_id, url, p_size AS sz, regexp_extract(url, '([0-9]+)(?:\\?|$)', 1) AS key, i FROM ap, range(0, 9) t(i)
       WHERE p_size IS NOT NULL AND (p_size >= CASE i WHEN 0 THEN 5 WHEN 1 THEN 10 WHEN 2 THEN 15 WHEN 3 THEN 20 WHEN 8 THEN 99 ELSE 30 END OR (i = 8 AND p_size % 4 = 3))),
images AS (SELECT page_id, url, sz, i, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INT AS idx,
  CASE i WHEN 0 THEN '/img/' || key || '.jpg' WHEN 1 THEN '/img/b' || sz || '.webp' WHEN 2 THEN '/img/spacer.gif' WHEN 3 THEN '/img/c.png'
    WHEN 5 THEN '/img/e.png' WHEN 6 THEN 'data:image/png;base64,AA' WHEN 8 THEN '/i.png' ELSE '/img/d.png' END AS src,
  CASE i WHEN 0 THEN p.p_name WHEN 1 THEN NULL WHEN 2 THEN CASE WHEN sz % 2 = 0 THEN 'line' ELSE '' END WHEN 3 THEN 'c' WHEN 4 THEN 'd' WHEN 5 THEN ' ' WHEN 6 THEN 'inline' WHEN 8 THEN 'Up' ELSE 'again' END AS alt,
  i IN (1, 3) OR (i = 4 AND sz % 2 = 0) AS is_lazy, i IN (3, 4) AS is_modern, i IN (3, 4) AS is_responsive, i = 4 AS has_srcset, i = 3 AS in_picture, CASE i WHEN 0 THEN 400 WHEN 1 THEN 100 END AS width
  FROM im JOIN part p ON p.p_partkey = page_id - 1000000000),
img AS (SELECT *, idx < 2 AS above_fold, CASE WHEN src LIKE '/%' THEN {ORIGIN} || src END AS resolved_url FROM images),
sset AS (SELECT page_id, idx, {ORIGIN} || x AS candidate_url FROM img, (SELECT unnest(['/img/d.webp', '/img/d3.png']) AS x) WHERE i = 4),
probe AS (SELECT resolved_url, length(resolved_url) % 5 <> 0 AS ok, length(resolved_url) * 6000 AS file_size_bytes, length(resolved_url) * 20 AS actual_width
  FROM (SELECT resolved_url FROM img WHERE resolved_url IS NOT NULL UNION SELECT candidate_url FROM sset))"""

EXT_IMAGES = f"WITH {IMAGES} SELECT page_id, idx, src, alt, resolved_url, is_lazy, is_modern, is_responsive, has_srcset, in_picture, above_fold, width FROM img"
EXT_SRCSET = f"WITH {IMAGES} SELECT * FROM sset"
IMAGE_STATUS = f"""WITH {IMAGES} SELECT page_id, idx, resolved_url, ok, coalesce(actual_width / width >= 1.5, false) AS too_many_pixels, ok AND file_size_bytes > 204800 AS too_many_bytes
FROM img JOIN probe USING (resolved_url)"""
DUP_IMAGES = f"WITH {IMAGES} SELECT page_id, resolved_url, count(*) AS n FROM img WHERE resolved_url IS NOT NULL GROUP BY ALL HAVING count(*) > 1"
IMAGE_REPORT_BODY = """SELECT page_id, count(*) AS n_images, count_if(NOT is_lazy AND NOT above_fold)::BIGINT AS n_missing_lazy, count_if(is_lazy AND above_fold)::BIGINT AS n_lazy_above_fold,
count_if(NOT has_srcset AND NOT in_picture)::BIGINT AS n_missing_srcset, count_if(NOT is_modern AND NOT in_picture)::BIGINT AS n_legacy_format, count_if(alt = '')::BIGINT AS n_decorative,
count_if(alt IS NULL)::BIGINT AS n_missing_alt, count_if(is_responsive)::BIGINT AS n_responsive, count_if(NOT is_responsive)::BIGINT AS n_fixed FROM img GROUP BY page_id"""
IMAGE_REPORT = f"WITH {IMAGES} {IMAGE_REPORT_BODY}"
AUDIT_IMAGES = f"""WITH {IMAGES}, rep AS ({IMAGE_REPORT_BODY}),
ov AS (SELECT page_id, count_if(coalesce(actual_width / width >= 1.5, false) OR (ok AND file_size_bytes > 204800)) no_ FROM img JOIN probe USING (resolved_url) GROUP BY page_id),
br AS (SELECT page_id, count_if(NOT ok) nb FROM (SELECT page_id, resolved_url FROM img UNION SELECT page_id, candidate_url FROM sset) JOIN probe USING (resolved_url) GROUP BY page_id),
f AS (SELECT page_id, coalesce(no_, 0) o, coalesce(n_missing_alt, 0) a, coalesce(n_legacy_format, 0) l, coalesce(n_missing_lazy, 0) z, coalesce(n_lazy_above_fold, 0) v, coalesce(nb, 0) b
  FROM ap LEFT JOIN rep USING (page_id) LEFT JOIN ov USING (page_id) LEFT JOIN br USING (page_id))
SELECT page_id, CASE WHEN o > 0 THEN 'images-oversized' ELSE 'images-sized-ok' END AS rule_id, o = 0 AS passed, CASE WHEN o > 0 THEN 6 ELSE 0 END AS weight, CASE WHEN o > 0 THEN 'medium' ELSE 'good' END AS severity FROM f
UNION ALL SELECT page_id, CASE WHEN a > 0 THEN 'images-missing-alt' ELSE 'images-alt-ok' END, a = 0, CASE WHEN a > 0 THEN 5 ELSE 0 END, CASE WHEN a > 0 THEN 'medium' ELSE 'good' END FROM f
UNION ALL SELECT page_id, CASE WHEN l > 0 THEN 'images-legacy-format' ELSE 'images-modern-format' END, l = 0, CASE WHEN l > 0 THEN 2 ELSE 0 END, CASE WHEN l > 0 THEN 'low' ELSE 'good' END FROM f
UNION ALL SELECT page_id, CASE WHEN z > 0 THEN 'images-no-lazy-load' ELSE 'images-lazy-ok' END, z = 0, CASE WHEN z > 0 THEN 2 ELSE 0 END, CASE WHEN z > 0 THEN 'low' ELSE 'good' END FROM f
UNION ALL SELECT page_id, 'images-lazy-above-fold', false, 4, 'medium' FROM f WHERE v > 0
UNION ALL SELECT page_id, 'images-broken', false, 8, 'high' FROM f WHERE b > 0"""

# --- URLs ---------------------------------------------------------------------------------------------------

NORMALIZE = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({u}, '#.*$', ''), '([?&])(?:utm_source|utm_medium|utm_campaign|utm_term|utm_content|fbclid|gclid)=[^&#]*&?', '\1', 'g'), '[?&]$', ''),
 '^([a-z]+://[^/?#]+/[^?#]*[^/?#])/(\?.*)?$', '\1\2')"""


def normalize(u: str) -> str:
    return NORMALIZE.replace("{u}", u)


# --- duplicates -----------------------------------------------------------------------------------------------

DOCS = f"d AS (SELECT doc_id AS id, lower({collapse('text')}) AS text FROM documents)"
LONG = f"k AS (SELECT id, text, sha256(text) AS body_key FROM d WHERE {words('text')} >= 30)"
EXACT = "g AS (SELECT body_key, count(*) AS n, min(id) AS first_id FROM k GROUP BY 1 HAVING count(*) > 1)"
SOLO = "s AS (SELECT * FROM k WHERE body_key NOT IN (SELECT body_key FROM g))"
NEAR = r"""w AS (SELECT id, string_split(text, ' ') AS ws FROM s),
sh AS (SELECT id, unnest(list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))) AS x FROM w),
n AS (SELECT id, count(*) AS n FROM sh GROUP BY id),
p AS (SELECT a.id AS ia, b.id AS ib, count(*) AS common FROM sh a JOIN sh b ON a.x = b.x AND a.id < b.id GROUP BY ALL),
near AS (SELECT ia AS id_a, ib AS id_b, common / (na.n + nb.n - common) AS similarity FROM p JOIN n na ON na.id = ia JOIN n nb ON nb.id = ib
  WHERE common / (na.n + nb.n - common) >= 0.9)"""
REPS = "s AS (SELECT min(id) AS id, any_value(text) AS text FROM k GROUP BY body_key)"


def near_reps(threshold: float) -> str:
    """Near duplicates among distinct texts."""
    return f"WITH {DOCS}, {LONG}, {REPS}, {NEAR.replace('0.9', str(threshold))}"


DUP_ALL = f"WITH {DOCS}, {LONG}, {EXACT}, {SOLO}, {NEAR}"

STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
KEYWORDS = f"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9'']{{3,}}') AS ws FROM documents),
c AS (SELECT doc_id, len(ws) AS total, unnest(ws) AS word FROM t), n AS (SELECT doc_id, word, any_value(total) AS total, count(*) AS n FROM c WHERE word NOT IN ({STOP}) GROUP BY ALL)
SELECT * FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS rank, word, n, round(n * 100.0::DOUBLE / total, 2) AS density FROM n) WHERE rank <= 8"""

MAIN_TEXT = f"lower({collapse(strip(r'''regexp_replace(''' + SKEL + r''', '(?is)<nav[^>]*>.*?</nav>|<header[^>]*>.*?</header>|<footer[^>]*>.*?</footer>|<svg[^>]*>.*?</svg>', '', 'g')'''))})"
