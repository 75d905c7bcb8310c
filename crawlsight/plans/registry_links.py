"""Links, images, URLs, duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlsight.functions import text as T
from crawlsight.functions import urls as U
from crawlsight.operators import duplicates as D
from crawlsight.operators import extract as X
from crawlsight.operators import images as I
from crawlsight.operators import links as L
from crawlsight.plans import oracle_links as O
from crawlsight.plans.catalog import register
from crawlsight.plans.oracle_pages import AUDIT_PAGES, H23, HEADS, NC, SITE, SKEL, collapse, decode, meta, strip, words
from crawlsight.session import spread, stored
from crawlsight.sources import given as G

c = F.col


def _links(spark, sf):
    return L.links(G.audit_pages(spark, sf))


def _link_status(links_df):
    """Check results derived from the links themselves: the status follows the URL's length."""
    n = F.length("resolved_url")
    return L.checkable(links_df).select("resolved_url").distinct().select(
        "resolved_url", (n % 7 != 0).alias("ok"),
        F.when(n % 7 != 0, 200).when(n % 14 == 0, 404).alias("status_code"),
        F.when(n % 7 == 0, F.lit("HTTP error")).alias("error"))


def _probes(images_df):
    n = F.length("resolved_url")
    return I.image_urls(images_df).select(
        "resolved_url", (n % 5 != 0).alias("ok"), (n * 6000).alias("file_size_bytes"), (n * 20).alias("actual_width"))


@register("ext_links", O.EXT_LINKS)
def ext_links(spark, sf):
    return L.raw_links(G.audit_pages(spark, sf)).select("page_id", "pos", "href", "text", "rel", "target", "img_alt")


@register("ext_link_class", O.LINK_CLASS)
def ext_link_class(spark, sf):
    return _links(spark, sf).select("page_id", "pos", "kind", "resolved_url", "is_external", "has_no_text", "missing_noopener")


@register("agg_link_counts", O.LINK_COUNTS)
def agg_link_counts(spark, sf):
    return L.link_counts(_links(spark, sf))


@register("agg_dup_links", O.DUP_LINKS)
def agg_dup_links(spark, sf):
    return L.duplicate_links(_links(spark, sf))


@register("agg_link_refs", O.LINK_REFS)
def agg_link_refs(spark, sf):
    return L.link_refs(_links(spark, sf))


@register("topk_links_by_refs", O.TOPK_LINKS)
def topk_links_by_refs(spark, sf):
    return L.most_referenced(L.link_refs(_links(spark, sf)))


@register("join_link_status", O.LINK_STATUS)
def join_link_status(spark, sf):
    links = stored(_links(spark, sf), "links")
    return L.join_status(links, L.dedupe_status(_link_status(links))).select("page_id", "pos", "resolved_url", "ok", "status_code")


register("src_link_status", f"WITH {O.LINKS}, {O.STATUS} SELECT * FROM status")(
    lambda spark, sf: _link_status(_links(spark, sf)).select("resolved_url", "ok", "status_code"))


@register("lim_affected_pages", O.AFFECTED)
def lim_affected_pages(spark, sf):
    links = _links(spark, sf)
    return L.affected_pages(links, _link_status(links).filter(~c("ok")))


@register("set_distinct_urls", O.DISTINCT_URLS)
def set_distinct_urls(spark, sf):
    return L.checkable(_links(spark, sf)).select("resolved_url").dropDuplicates()


@register("audit_links_page", O.AUDIT_LINKS)
def audit_links_page(spark, sf):
    pages = G.audit_pages(spark, sf)
    links = stored(L.links(pages).select("page_id", "kind", "resolved_url", "is_external", "has_no_text", "missing_noopener"), "page-links")
    return L.audit_links_page(pages, _link_status(links), links).select("page_id", "rule_id", "passed", "weight", "n", "severity")


@register("audit_links_site", O.AUDIT_LINKS_SITE)
def audit_links_site(spark, sf):
    links = stored(_links(spark, sf), "links")
    return L.audit_links_site(links, _link_status(links)).select("rule_id", "passed", "weight", "n")


# --- images


def _images(spark, sf):
    return I.images(G.audit_pages(spark, sf))


@register("ext_images", O.EXT_IMAGES)
def ext_images(spark, sf):
    return _images(spark, sf).select(
        "page_id", "idx", "src", "alt", "resolved_url", "is_lazy", "is_modern", "is_responsive", "has_srcset", "in_picture", "above_fold", "width")


register("ext_srcset", O.EXT_SRCSET)(lambda spark, sf: I.srcset(_images(spark, sf)))
register("win_image_order", f"WITH {O.IMAGES} SELECT page_id, idx, above_fold FROM img")(
    lambda spark, sf: _images(spark, sf).select("page_id", "idx", "above_fold"))
register("ext_extension", f"WITH {O.IMAGES} SELECT page_id, idx, lower(regexp_extract(resolved_url, '\\.([a-z0-9]+)$', 1)) AS extension FROM img WHERE resolved_url IS NOT NULL")(
    lambda spark, sf: _images(spark, sf).filter(c("resolved_url").isNotNull()).select("page_id", "idx", U.extension(c("resolved_url")).alias("extension")))
register("agg_dup_images", O.DUP_IMAGES)(lambda spark, sf: I.duplicate_images(_images(spark, sf)))
register("agg_image_report", O.IMAGE_REPORT)(lambda spark, sf: I.image_report(_images(spark, sf)))


@register("join_image_status", O.IMAGE_STATUS)
def join_image_status(spark, sf):
    imgs = stored(_images(spark, sf), "images")
    return I.join_status(imgs, _probes(imgs)).select("page_id", "idx", "resolved_url", "ok", "too_many_pixels", "too_many_bytes")


@register("src_image_status", f"""WITH {O.IMAGES} SELECT resolved_url, CASE WHEN length(resolved_url) % 2 = 0 THEN length(resolved_url) * 9000 ELSE length(resolved_url) * 7 END::BIGINT AS file_size_bytes FROM probe""")
def src_image_status(spark, sf):
    """Size of a probed image: the total of Content-Range, else Content-Length."""
    n = F.length("resolved_url")
    raw = I.image_urls(_images(spark, sf)).select(
        "resolved_url", F.when(n % 2 == 0, F.concat(F.lit("bytes 0-65535/"), (n * 9000).cast("string"))).alias("content_range"),
        (n * 7).cast("string").alias("content_length"))
    total = F.get(F.split("content_range", "/"), F.lit(1)).try_cast("long")
    return raw.select("resolved_url", F.coalesce(total, c("content_length").try_cast("long")).alias("file_size_bytes"))


@register("audit_images", O.AUDIT_IMAGES)
def audit_images(spark, sf):
    pages = G.audit_pages(spark, sf)
    imgs = stored(I.images(pages), "images")
    return I.audit_images(pages, imgs, _probes(imgs)).select("page_id", "rule_id", "passed", "weight", "severity")


# --- URLs


@register("url_normalize", f"WITH {AUDIT_PAGES} SELECT page_id, {O.normalize('url')} AS norm_url FROM ap")
def url_normalize(spark, sf):
    return G.audit_pages(spark, sf).select("page_id", U.normalize(c("url")).alias("norm_url"))


@register("url_crawlable", f"""WITH {O.LINKS} SELECT page_id, pos::INT AS pos, regexp_extract(resolved_url, '^(https?://[^/?#]+)', 1) = regexp_extract(url, '^(https?://[^/?#]+)', 1)
  AND NOT regexp_matches(lower(regexp_extract(resolved_url, '^[^?#]*')), '\\.(pdf|jpg|png|css|js)$') AS crawlable FROM links WHERE kind = 'link'""")
def url_crawlable(spark, sf):
    return L.checkable(_links(spark, sf)).select("page_id", "pos", U.crawlable(c("resolved_url"), U.origin(c("url"))).alias("crawlable"))


@register("url_safe", """SELECT o_orderkey, NOT (a IN (0, 10, 127) OR a >= 224 OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 169 AND b = 254) OR (a = 100 AND b BETWEEN 64 AND 127))
  AND o_orderpriority <> '5-LOW' AND o_orderpriority <> '1-URGENT' AS safe FROM (SELECT *, o_orderkey % 256 AS a, o_custkey % 256 AS b FROM orders)""")
def url_safe(spark, sf):
    """Addresses made of the order keys; two priorities stand for a foreign scheme and an internal name."""
    host = F.concat_ws(".", c("o_orderkey") % 256, c("o_custkey") % 256, F.lit(1), F.lit(1))
    url = (
        F.when(c("o_orderpriority") == "5-LOW", F.concat(F.lit("ftp://"), host))
        .when(c("o_orderpriority") == "1-URGENT", F.lit("http://db.internal/x")).otherwise(F.concat(F.lit("https://"), host, F.lit(":8080/x"))))
    return G.table(spark, sf, "orders").select("o_orderkey", U.is_safe(url).alias("safe"))


@register("url_path_label", f"""WITH {AUDIT_PAGES} SELECT page_id, coalesce(nullif(regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '') || regexp_extract(url, '(\\?[^#]*)', 1), ''), '/') AS label FROM ap""")
def url_path_label(spark, sf):
    return G.audit_pages(spark, sf).select("page_id", U.path_label(c("url")).alias("label"))


@register("join_canonical_targets", f"""WITH {AUDIT_PAGES}, s AS (SELECT page_id, url, {decode('''regexp_extract(html, '<link rel="canonical" href="([^"]*)"', 1)''')} AS k FROM ap)
SELECT page_id, CASE WHEN k = '' THEN 'missing' WHEN k NOT LIKE 'http%' THEN 'relative' WHEN regexp_extract(k, '^(https?://[^/]+)', 1) = regexp_extract(url, '^(https?://[^/?#]+)', 1) THEN 'same-origin' ELSE 'cross-domain' END AS target FROM s""")
def join_canonical_targets(spark, sf):
    f = X.page_features(G.audit_pages(spark, sf))
    k = c("canonical")
    return f.select("page_id", F.when(k == "", "missing").when(~k.rlike("(?i)^https?://"), "relative")
                    .when(U.origin(k) == U.origin(c("url")), "same-origin").otherwise("cross-domain").alias("target"))


# --- text and duplicates


@register("ext_body_text", f"""WITH {AUDIT_PAGES}, t AS (SELECT page_id, {collapse(strip("regexp_replace(" + NC + ", '(?is)^.*?<body[^>]*>', '')"))} AS body_text FROM ap)
SELECT page_id, body_text, ({words('body_text')})::BIGINT AS n_words FROM t""")
def ext_body_text(spark, sf):
    return X.page_features(G.audit_pages(spark, sf)).select("page_id", "body_text", "n_words")


@register("ext_main_text", f"WITH {AUDIT_PAGES} SELECT page_id, {O.MAIN_TEXT} AS text FROM ap")
def ext_main_text(spark, sf):
    return X.main_text(G.audit_pages(spark, sf)).select("page_id", "text")


@register("ext_content_text", f"""WITH {AUDIT_PAGES}, t AS (SELECT page_id, {collapse(strip("regexp_replace(" + SKEL + ", '(?is)^.*?<body[^>]*>', '')"))} AS x FROM ap)
SELECT page_id, len(regexp_extract_all(lower(x), '[a-z0-9'']{{3,}}'))::BIGINT AS n_tokens, x AS content FROM t""")
def ext_content_text(spark, sf):
    t = G.audit_pages(spark, sf).select("page_id", X.content_text_column(c("html")).alias("content"))
    return t.select("page_id", F.size(F.regexp_extract_all(F.lower("content"), F.lit("[a-z0-9']{3,}"), F.lit(0))).cast("long").alias("n_tokens"), "content")


def _docs(spark, sf):
    return D.normalised(spread(G.table(spark, sf, "documents")), "doc_id", "text")


T_SQL = "regexp_extract(" + NC + ", '(?is)<title>(.*?)</title>', 1)"
D_SQL = """regexp_extract(html, '<meta name="description" content="([^"]*)"', 1)"""
_HEADS = f"h AS (SELECT page_id, lower({collapse(decode(T_SQL))}) AS title, lower({collapse(decode(D_SQL))}) AS description FROM ap)"
_SAME = " UNION ALL ".join(f"SELECT '{k}' AS kind, page_id AS id, n, first_id FROM h JOIN (SELECT {k}, count(*) AS n, min(page_id) AS first_id FROM h WHERE {k} <> '' GROUP BY 1 HAVING count(*) > 1) USING ({k})" for k in ("title", "description"))


@register("agg_dup_groups", f"WITH {AUDIT_PAGES}, {_HEADS}, {O.DOCS}, {O.LONG}, {O.EXACT} {_SAME} UNION ALL SELECT 'body', k.id, g.n, g.first_id FROM k JOIN g USING (body_key)")
def agg_dup_groups(spark, sf):
    """Pages with a title or a description that others have, documents with a body that others have."""
    heads = stored(X.head_texts(G.audit_pages(spark, sf)), "page-heads")
    keys = lambda x: heads.select(c("page_id").alias("id"), F.lower(T.collapse_ws(c(x))).alias("key"))
    rows = lambda kind, df: df.select(F.lit(kind).alias("kind"), "id", "n", "first_id")
    return rows("title", D.members(keys("title"), "key")).unionByName(rows("description", D.members(keys("meta_desc"), "key"))).unionByName(rows("body", D.member_rows(_docs(spark, sf))))


@register("anti_exact_dupes", f"WITH {O.DOCS}, {O.LONG}, {O.EXACT}, {O.SOLO} SELECT id FROM s")
def anti_exact_dupes(spark, sf):
    return D.without_exact(D.body_keys(_docs(spark, sf))).select("id")


def _near(spark, sf, threshold):
    return D.near_duplicates(D.shingle_sets(D.representatives(D.text_batches(D.body_keys(_docs(spark, sf))))), threshold)


@register("join_near_dup", O.near_reps(0.9) + " SELECT id_a, id_b, round(similarity, 6) AS similarity FROM near")
def join_near_dup(spark, sf):
    """Distinct texts with similarity of at least 0.9."""
    return _near(spark, sf, 0.9).select("id_a", "id_b", F.round("similarity", 6).alias("similarity"))


@register("srt_near_dup", O.near_reps(0.7) + " SELECT id_a, id_b, round(similarity, 6) AS similarity FROM near ORDER BY 3 DESC, 1, 2")
def srt_near_dup(spark, sf):
    return _near(spark, sf, 0.7).select("id_a", "id_b", F.round("similarity", 6).alias("similarity")).orderBy(F.desc("similarity"), "id_a", "id_b")


@register("set_intersect_shingles", O.near_reps(0.7) + " SELECT ia AS id_a, ib AS id_b, common FROM p JOIN near ON ia = id_a AND ib = id_b")
def set_intersect_shingles(spark, sf):
    """Shared shingles of each similar pair, counted where its similarity is."""
    return _near(spark, sf, 0.7).select("id_a", "id_b", "common")


@register("audit_duplicates", f"""WITH {AUDIT_PAGES}, h AS (SELECT page_id, lower({collapse(decode("regexp_extract(" + NC + ", '(?is)<title>(.*?)</title>', 1)"))}) AS t, lower({collapse(decode('''regexp_extract(html, '<meta name="description" content="([^"]*)"', 1)'''))}) AS m FROM ap),
{O.DOCS}, {O.LONG}, {O.EXACT}, {O.SOLO}, {O.NEAR},
a AS (SELECT (SELECT count(*) FROM (SELECT t FROM h WHERE t <> '' GROUP BY t HAVING count(*) > 1)) nt, (SELECT count(*) FROM (SELECT m FROM h WHERE m <> '' GROUP BY m HAVING count(*) > 1)) nm,
  (SELECT count(*) FROM g) ng, (SELECT count(*) FROM near) nn)
SELECT 'duplicate-title' AS rule_id, 8 AS weight, nt AS n FROM a WHERE nt > 0 UNION ALL SELECT 'duplicate-meta-description', 5, nm FROM a WHERE nm > 0
UNION ALL SELECT 'duplicate-body-content', 10, ng FROM a WHERE ng > 0 UNION ALL SELECT 'near-duplicate-content', 6, nn FROM a WHERE nn > 0""")
def audit_duplicates(spark, sf):
    """Titles and descriptions of the pages, bodies of the documents."""
    heads = stored(X.head_texts(G.audit_pages(spark, sf)), "page-heads")
    key = lambda x: heads.select(c("page_id").alias("id"), F.lower(T.collapse_ws(c(x))).alias("key"))
    return D.audit_duplicates(key("title"), key("meta_desc"), _docs(spark, sf)).select("rule_id", "weight", "n")


register("agg_keyword_density", O.KEYWORDS)(lambda spark, sf: D.keyword_density(spread(G.table(spark, sf, "documents")), "doc_id", "text"))
register("topk_keywords", f"SELECT doc_id, word FROM ({O.KEYWORDS}) WHERE rank <= 8")(
    lambda spark, sf: D.keyword_density(spread(G.table(spark, sf, "documents")), "doc_id", "text").select("doc_id", "word"))
