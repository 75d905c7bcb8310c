"""Generated files and report sinks: text built from columns, written by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlsight.functions import text as T
from crawlsight.functions import urls as U
from crawlsight.session import stored

c = F.col

#: Entries of a sitemap file, as many as the protocol allows.
SITEMAP_ENTRIES = 50_000
SITEMAP = '<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'


def sitemap_lines(pages: DataFrame, day: str, entries: int = SITEMAP_ENTRIES) -> DataFrame:
    """``gen_sitemap``: one <url> entry per page, in the order of addresses, and the file of its site it belongs to.

    A site's files hold exactly ``entries`` pages each, but for the last. A site may have a third of all pages: they are
    sorted by range over all tasks, and a page's number is its place in its range after the site's pages before it.
    """
    placed = stored(pages.select("site", "url").repartitionByRange("site", "url").withColumn("range", F.spark_partition_id()), "sitemap-pages")
    counts = placed.groupBy("site", "range").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("site").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("site", "range", F.coalesce(before, F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("site", "range").orderBy("url"))
    entry = F.concat(F.lit("  <url><loc>"), T.escape_xml(c("url")), F.lit(f"</loc><lastmod>{day}</lastmod></url>"))
    return placed.withColumn("place", place).join(bases, ["site", "range"]).select(
        "site", F.floor((c("base") + c("place") - 1) / entries).cast("int").alias("file_no"), "url", entry.alias("line"))


def sitemap_index(lines: DataFrame, day: str) -> DataFrame:
    """``gen_sitemap``: the entries of each site's index, one per file."""
    files = lines.select("site", "file_no").distinct()
    loc = F.concat(F.lit("https://"), c("site"), F.lit("/sitemap-"), (c("file_no") + 1).cast("string"), F.lit(".xml"))
    return files.select("site", "file_no", F.concat(F.lit("  <sitemap><loc>"), T.escape_xml(loc), F.lit(f"</loc><lastmod>{day}</lastmod></sitemap>")).alias("line"))


def write_sitemaps(lines: DataFrame, out: str) -> None:
    """Entry lines partitioned by site and file; the head and foot lines sort first and last."""
    entries = lines.select("site", "file_no", F.lit(1).alias("part"), "url", "line")
    ends = lines.select("site", "file_no").distinct().select("site", "file_no", F.explode(F.array(
        F.struct(F.lit(0).alias("part"), F.lit(SITEMAP).alias("line")), F.struct(F.lit(2).alias("part"), F.lit("</urlset>").alias("line")))).alias("e")).select("site", "file_no", "e.part", F.lit("").alias("url"), "e.line")
    entries.unionByName(ends).repartition("site", "file_no").sortWithinPartitions("site", "file_no", "part", "url").select("site", "file_no", "line").write.mode(
        "overwrite").partitionBy("site", "file_no").text(out)


def robots_txt(sites: DataFrame, bots: list[str], allowed: Column, disallow: Column) -> DataFrame:
    """``gen_robots``: (site, text). ``allowed`` is the array of allowed bots, ``disallow`` of closed paths."""
    closed = F.when(F.size(disallow) == 0, F.lit("Disallow:")).otherwise(F.array_join(F.transform(disallow, lambda p: F.concat(F.lit("Disallow: "), p)), "\n"))
    groups = F.array_join(F.array(*[
        F.concat(F.lit(f"User-agent: {b}\n"), F.when(F.array_contains(allowed, b), "Allow: /").otherwise("Disallow: /")) for b in bots]), "\n\n")
    return sites.select("site", F.concat(
        F.lit("User-agent: *\n"), closed, F.lit("\n\n"), groups, F.lit("\n\nSitemap: https://"), c("site"), F.lit("/sitemap.xml\n")).alias("text"))


def llms_txt(pages: DataFrame, n: int = 25) -> DataFrame:
    """``gen_llms_txt``: a link line for the first pages of each site (by address)."""
    bucket = Window.partitionBy("site", "b").orderBy("url")
    whole = Window.partitionBy("site").orderBy("url")
    p = F.regexp_replace(U.path(c("url")), "/+$", "")
    label = F.when(p == "", "Home").otherwise(F.substr(p, F.lit(2)))
    return (
        pages.select("site", "url").withColumn("b", F.pmod(F.xxhash64("url"), F.lit(64)))
        .withColumn("rn", F.row_number().over(bucket)).filter(c("rn") <= n).withColumn("rn", F.row_number().over(whole)).filter(c("rn") <= n)
        .withColumn("line", F.concat(F.lit("- ["), label, F.lit("]("), c("url"), F.lit(")")))
        .groupBy("site").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "line"))), lambda x: x["line"]), "\n").alias("links"))
        .select("site", F.concat(F.lit("# "), F.regexp_replace("site", r"^www\.", ""), F.lit("\n\n## Pages\n\n"), c("links"), F.lit("\n")).alias("text")))


def meta_tags(df: DataFrame, title: Column, description: Column, url: Column, image: Column) -> DataFrame:
    """``gen_meta_tags``: head tags, and warnings about lengths and a missing image."""
    tag = lambda pre, v, post: F.when(v != "", F.concat(F.lit(pre), T.escape_attr(v), F.lit(post)))
    prop = lambda kind, name, v: tag(f'<meta {kind}="{name}" content="', v, '" />')
    lines = F.concat_ws(
        "\n", tag("<title>", title, "</title>"), prop("name", "description", description), tag('<link rel="canonical" href="', url, '" />'),
        prop("property", "og:title", title), prop("property", "og:description", description), F.lit('<meta property="og:type" content="website" />'),
        prop("property", "og:url", url), prop("property", "og:image", image),
        F.when(image != "", '<meta name="twitter:card" content="summary_large_image" />').otherwise('<meta name="twitter:card" content="summary" />'),
        prop("name", "twitter:title", title), prop("name", "twitter:description", description), prop("name", "twitter:image", image))
    warns = F.concat_ws(
        ";", F.when((title != "") & ~F.length(title).between(10, 60), "title"), F.when((description != "") & ~F.length(description).between(50, 160), "description"),
        F.when(image == "", "image"))
    return df.select("*", lines.alias("head"), warns.alias("warnings"))


def _some(v: Column) -> Column:
    return F.nullif(v, F.lit(""))


def jsonld(kind: str, **f: Column) -> Column:
    """``gen_jsonld``: JSON-LD text of one of eleven types; empty fields are dropped."""
    g = lambda k: _some(f[k]) if k in f else F.lit(None).cast("string")
    typed = lambda t, cond, **kv: F.when(cond.isNotNull(), F.struct(F.lit(t).alias("@type"), *[v.alias(k) for k, v in kv.items()]))
    fields: dict[str, list[tuple[str, Column]]] = {
        "Organization": [("name", g("name")), ("url", g("url")), ("logo", g("logo"))],
        "Person": [("name", g("name")), ("url", g("url")), ("jobTitle", g("jobTitle"))],
        "Article": [("headline", g("headline")), ("author", typed("Person", g("author"), name=g("author"))), ("datePublished", g("datePublished")), ("image", g("image"))],
        "Product": [("name", g("name")), ("description", g("description")), ("image", g("image")), ("brand", typed("Brand", g("brand"), name=g("brand"))),
                    ("offers", typed("Offer", g("price"), price=g("price"), priceCurrency=F.coalesce(g("priceCurrency"), F.lit("USD"))))],
        "WebSite": [("name", g("name")), ("url", g("url"))],
        "WebPage": [("name", g("name")), ("description", g("description")), ("url", g("url"))],
        "SoftwareApplication": [("name", g("name")), ("applicationCategory", g("applicationCategory")), ("operatingSystem", g("operatingSystem")),
                                ("offers", typed("Offer", g("price"), price=g("price"), priceCurrency=F.lit("USD")))],
        "LocalBusiness": [("name", g("name")), ("telephone", g("telephone")), ("address", F.struct(F.lit("PostalAddress").alias("@type"), g("streetAddress").alias("streetAddress")))],
        "Event": [("name", g("name")), ("startDate", g("startDate")), ("endDate", g("endDate")), ("location", typed("Place", g("locationName"), name=g("locationName")))],
        "BreadcrumbList": [("itemListElement", F.transform(F.split(f["items"], "\n"), lambda x, i: F.struct(
            F.lit("ListItem").alias("@type"), (i + 1).alias("position"), F.trim(F.substring_index(x, "|", 1)).alias("name"),
            F.when(F.instr(x, "|") > 0, F.trim(F.substring_index(x, "|", -1))).alias("item"))))] if "items" in f else [],
        "FAQPage": [("mainEntity", F.transform(F.split(f["items"], "\n"), lambda x: F.struct(
            F.lit("Question").alias("@type"), F.trim(F.substring_index(x, "|", 1)).alias("name"),
            F.struct(F.lit("Answer").alias("@type"), F.trim(F.substring_index(x, "|", -1)).alias("text")).alias("acceptedAnswer"))))] if "items" in f else [],
    }
    return F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit(kind).alias("@type"), *[v.alias(k) for k, v in fields[kind]]))


def hreflang(entries: Column, x_default: bool = True) -> Column:
    """``gen_hreflang``: tags of an array of (lang, url); x-default falls back to the first entry."""
    tag = lambda lang, url: F.concat(F.lit('<link rel="alternate" hreflang="'), T.escape_attr(lang), F.lit('" href="'), T.escape_attr(url), F.lit('" />'))
    good = F.filter(entries, lambda e: (e["lang"] != "") & (e["url"] != ""))
    lines = F.transform(good, lambda e: tag(e["lang"], e["url"]))
    return F.array_join(F.concat(lines, F.array(tag(F.lit("x-default"), F.get(entries, F.lit(0))["url"]))) if x_default else lines, "\n")


def keyword_search(docs: DataFrame, id_col: str, text_col: str, query: str, limit: int = 3) -> DataFrame:
    """``topk_keyword_search``: documents by summed occurrences of the query's terms, with a snippet."""
    terms = [t for t in dict.fromkeys(query.lower().split()) if len(t) > 3]
    low = F.lower(c(text_col))
    hits = lambda t: (F.length(low) - F.length(F.replace(low, F.lit(t), F.lit("")))) / F.lit(len(t))
    score = sum((hits(t) for t in terms), F.lit(0)).cast("long")
    at = F.coalesce(*[F.nullif(F.instr(low, t), F.lit(0)) for t in terms], F.lit(1))
    return docs.select(c(id_col), score.alias("score"), F.substring(c(text_col), F.greatest(at - 200, F.lit(1)), F.lit(900)).alias("snippet")).filter(
        c("score") > 0).orderBy(F.desc("score"), id_col).limit(limit)
