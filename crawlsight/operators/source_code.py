"""Checks on source files of web projects, and the integrity of rewritten files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlsight.functions.findings import Checks, explode_findings
from crawlsight.functions.text import let, redact

c = F.col

# Tags that are links, calls to action and images in the templates of common frameworks.
ANCHOR_TAGS = "a|Link|NuxtLink|nuxt-link|router-link|RouterLink"
CTA_TAGS = ANCHOR_TAGS + "|button"
IMAGE_TAGS = "img|Image|NuxtImg|nuxt-img|Img"
#: End of a tag; one that an arrow function's sign cuts short does not count.
END = r"[^>]*(?<!=)>"
# Check id, category, severity, pattern counted in the file.
COUNTED = [
    ("noopener", "Conversions", "medium", rf"""<(?:{ANCHOR_TAGS})\b(?=[^>]*target\s*=\s*["']_blank["'])(?![^>]*rel\s*=\s*["'][^"']*noopener){END}"""),
    ("missing-alt", "Accessibility", "high", rf"""<(?:{IMAGE_TAGS})\b(?![^>]*(?:\s|:|\[|v-bind:)alt\]?\s*=){END}"""),
    ("generic-cta", "Conversions", "low", rf"(?i)<({CTA_TAGS})\b[^>]*>\s*(?:submit|click here|here|go|learn more|read more)\s*</\1>"),
    ("clickable-role", "Accessibility", "high", rf"<(?:div|span)\b(?=[^>]*\s(?:onClick|onclick|@click|v-on:click|\(click\)|on:click)\s*=)(?![^>]*\s(?:role|tabindex|tabIndex)\s*=){END}"),
    ("hash-link", "Accessibility", "low", rf"""<(?:{ANCHOR_TAGS})\b(?=[^>]*href\s*=\s*(["'])#\1)(?=[^>]*\s(?:onClick|onclick|@click(?:\.\w+)*|v-on:click|\(click\)|on:click)\s*=){END}"""),
    ("srcset-sizes", "Performance", "low", r"(?i)<(?:img|Image)\b(?=[^>]*\ssrcset\s*=)(?![^>]*\ssizes\s*=)[^>]*>"),
    ("autoplay-muted", "Accessibility", "medium", rf"<(?:video|audio)\b(?=[^>]*\bautoplay)(?![^>]*\bmuted){END}"),
    ("autoplay-controls", "Accessibility", "low", rf"<(?:video|audio)\b(?=[^>]*\bautoplay)(?![^>]*\bcontrols){END}"),
    ("mixed-content", "Security", "medium", r"""(?i)\b(?:src|href)\s*=\s*(['"])http://(?!localhost|127\.0\.0\.1)[^'"]*\1"""),
    ("console", "Best Practices", "low", r"console\.(?:log|debug|trace)\s*\("),
    ("debugger", "Best Practices", "medium", r"(?:^|[^.\w])debugger\s*;"),
    ("xss-inner-html", "Security", "high", r"dangerouslySetInnerHTML\s*=\s*\{"),
    ("xss-v-html", "Security", "high", r"\bv-html\s*="),
    ("xss-bound-inner-html", "Security", "high", r"\[innerHTML\]\s*="),
    ("xss-at-html", "Security", "high", r"\{@html\b"),
    ("xss-set-html", "Security", "high", r"\bset:html\s*="),
    ("list-key", "Best Practices", "medium", r"\.map\(\s*(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*=>[\s\S]{0,40}?<[A-Za-z][\w.]*\b(?![^>]*\bkey\s*=)[^>]*>"),
    ("v-for-key", "Best Practices", "medium", r"<[A-Za-z][\w-]*\b(?=[^>]*\bv-for\s*=)(?![^>]*(?::key|v-bind:key)\s*=)[^>]*>"),
    ("ng-for-track-by", "Best Practices", "low", r"<[A-Za-z][\w-]*\b(?=[^>]*\*ngFor\s*=)(?![^>]*trackBy)[^>]*>"),
    ("table-headers", "Accessibility", "medium", r"(?i)<table\b[^>]*>(?:(?!<th\b|</table>)[\s\S])*</table>"),
]
# Shapes of credentials, and what may stand before one that is none.
SECRETS = [
    ("aws-access-key", r"\bAKIA[0-9A-Z]{16}\b"),
    ("google-api-key", r"\bAIza[0-9A-Za-z\-_]{35}\b"),
    ("stripe-live-key", r"\bsk_live_[0-9a-zA-Z]{20,}\b"),
    ("openai-api-key", r"\bsk-[A-Za-z0-9]{20,}\b"),
    ("slack-token", r"\bxox[baprs]-[0-9A-Za-z-]{10,}\b"),
    ("github-token", r"\bgh[pousr]_[A-Za-z0-9]{30,}\b"),
    ("private-key", r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----"),
    ("generic-secret", r"""(?i)\b(?:api[_-]?key|secret|token|password)\s*[:=]\s*["'][A-Za-z0-9_\-./+]{16,}["']"""),
]
NOT_SECRET = r"process\.env|import\.meta\.env|\$\{|__[A-Z_]+_PLACEHOLDER__"
# Rules with positions, and the files that they are for.
LIVE = [
    ("img-missing-alt", r"<(img|Image|NuxtImg|nuxt-img)\b(?![^>]*\balt=)[^>]*>", None),
    ("a-target-blank-noopener", r"""<a\b(?=[^>]*target=["']_blank["'])(?![^>]*\brel=["'][^"']*noopener)[^>]*>""", None),
    ("generic-cta-text", r"(?i)<(a|button)\b[^>]*>\s*(Click here|Submit|Learn more|Read more|Here|Go)\s*</\1>", None),
    ("clickable-div-no-role", r"<div\b(?=[^>]*\b(onClick|onclick|@click)\s*=)(?![^>]*\brole=)[^>]*>", None),
    ("console-debugger-statement", r"\b(console\.(log|debug|warn)|debugger)\b\s*[;(]", None),
    ("hardcoded-secret", r"""(?i)\b(?:api[_-]?key|secret|token|password)\s*[:=]\s*["'][A-Za-z0-9_\-./+]{12,}["']""", None),
    ("autoplay-video-not-muted", r"<video\b(?=[^>]*\bautoplay)(?![^>]*\bmuted)[^>]*>", None),
    ("img-no-lazy-loading", r"<(img|Image)\b(?![^>]*\bloading=)[^>]*>", None),
    ("form-field-missing-label", r"""<input\b(?![^>]*\btype=["'](hidden|submit|button)["'])(?![^>]*\baria-label)(?![^>]*\bid=)[^>]*>""", None),
    ("hash-only-link", r"""<a\b[^>]*href=["']#["'][^>]*>""", None),
    ("title-empty", r"<title>\s*</title>", r"(?i)\.html?$"),
    ("meta-description-empty", r"""(?i)<meta\s+name=["']description["']\s+content=["']\s*["']""", r"(?i)\.html?$"),
    ("missing-list-key", r"\.map\(\s*\([^)]*\)\s*=>\s*<[A-Za-z][\w.]*(?![^>]*\bkey=)", r"(?i)\.(jsx|tsx)$"),
    ("xss-risky-binding", r"dangerouslySetInnerHTML|v-html\s*=", None),
    ("mixed-content-http", r"""src=["']http://[^"']+["']""", None),
]


def kept_files(files: DataFrame) -> DataFrame:
    """``src_project_files``: path cleaned, build and vendor folders dropped."""
    segs = F.filter(F.split(F.replace(c("path"), F.lit("\\"), F.lit("/")), "/"), lambda s: ~s.isin("", ".", ".."))
    return files.withColumn("path", F.array_join(segs, "/")).filter(~c("path").rlike(r"(^|/)(node_modules|\.next|\.nuxt|\.svelte-kit|\.angular|\.git|dist|build|out)/"))


# Names of the files that say how a project is built and served.
META_FILES = r"(?:^|/)(?:package\.json|robots\.txt|sitemap\.xml|llms\.txt|next\.config\.(?:js|ts|mjs)|nuxt\.config\.(?:js|ts|mjs)|angular\.json|svelte\.config\.(?:js|ts|mjs)|astro\.config\.(?:js|ts|mjs)|vercel\.json|netlify\.toml|_headers)$"


def meta_files(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """``src_project_meta``: config and crawl files of a project, outside its dependencies and build output."""
    kept = kept_files(files).filter(c("path").rlike(META_FILES))
    return kept if max_bytes is None else kept.filter(F.octet_length("content") <= max_bytes)


def page_level(path: Column) -> Column:
    """``flt_page_level_file``"""
    return (
        path.rlike(r"(?i)(^|/)(page|layout|index|app|_app|_document)\.(tsx|jsx|vue|svelte)$") | path.rlike(r"(?i)(^|/)\+page(\.server)?\.(svelte|ts|js)$")
        | path.rlike(r"(?i)(^|/)(pages|views|routes|screens)/[^/]+\.(tsx|jsx|vue|svelte)$") | path.rlike(r"(?i)\.html?$"))


def next_route(path: Column) -> Column:
    """``ext_next_routes``: route of an app/**/page file, NULL for dynamic segments and other files."""
    inner = F.regexp_extract(path, r"(?:^|/)app/(.*?)/?page\.(?:tsx|jsx|ts|js)$", 1)
    segs = F.filter(F.split(inner, "/"), lambda s: (s != "") & ~s.rlike(r"^\(.*\)$"))
    return F.when(path.rlike(r"(?:^|/)app/(?:.*/)?page\.(?:tsx|jsx|ts|js)$") & ~inner.contains("["), F.concat(F.lit("/"), F.array_join(segs, "/")))


def pieces(text: Column, pattern: str) -> Column:
    """Every match of a pattern and the text between it and the match before, in order."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)  # one more than matches
    zipped = F.filter(F.arrays_zip(found.alias("match"), gaps.alias("gap")), lambda x: x["match"].isNotNull())
    return F.when(text.rlike(pattern), zipped)


def with_context(found: Column) -> Column:
    """match, and the 40 characters before it, of :func:`pieces` whose matches have at least 15 characters: no more than
    three matches reach into them."""
    empty = F.lit("")
    part = lambda x, i, back, name: F.coalesce(F.get(x, i - back)[name], empty)
    before = lambda x, i: F.concat(part(x, i, 3, "match"), part(x, i, 2, "gap"), part(x, i, 2, "match"), part(x, i, 1, "gap"), part(x, i, 1, "match"), part(x, i, 0, "gap"))
    return let(found, lambda f: F.transform(f, lambda m, i: F.struct(m["match"].alias("match"), F.right(before(f, i), F.lit(40)).alias("before"))))


def audit_files(files: DataFrame) -> DataFrame:
    """``audit_source_files``: one row per file and check that found something."""
    text, k = c("content"), Checks("source")
    for rule, _, severity, pattern in COUNTED:
        n = F.regexp_count(text, F.lit(pattern))
        k.issue(rule, 0, n > 0, n=n, severity=severity)
    for name, pattern in SECRETS:
        real = F.filter(with_context(pieces(text, pattern)), lambda s: ~s["before"].rlike(NOT_SECRET))
        first = F.get(F.transform(real, lambda s: s["match"]), F.lit(0))
        k.issue("secret-" + name, 0, first.isNotNull(), n=F.size(real), info=redact(first), severity="critical")
    tag = lambda names: F.regexp_extract_all(text, F.lit(rf"<(?:{names})\b{END}"), F.lit(0))
    has = lambda t, name: t.rlike(rf"(?i)(?:^|\s)(?:{name}|:{name}|v-bind:{name}|\[{name}\])\s*=") | t.rlike(rf"\{{\s*{name}\s*\}}")
    imgs = F.regexp_count(text, F.lit(rf"<(?:{IMAGE_TAGS})\b[^>]*>"))
    sized = F.regexp_count(text, F.lit(rf"<(?:{IMAGE_TAGS})\b(?=[^>]*\swidth\s*=)(?=[^>]*\sheight\s*=)[^>]*>"))
    k.issue("image-dimensions", 0, 2 * (imgs - sized) > imgs, n=imgs - sized, severity="high")
    k.issue("image-dimensions", 0, (imgs > sized) & (2 * (imgs - sized) <= imgs), n=imgs - sized, severity="medium")
    # the first two images of a file are likely in view and stay eager
    lazy = F.size(F.filter(tag(IMAGE_TAGS), lambda t, i: (i >= 2) & ~has(t, "loading") & ~has(t, "priority")))
    k.issue("lazy-images", 0, lazy > 0, n=lazy, severity="medium")
    unlabelled = F.regexp_replace(text, r"<label\b[^>]*>[\s\S]*?</label>", "")
    fields = F.regexp_extract_all(unlabelled, F.lit(rf"<(?:input|select|textarea)\b{END}"), F.lit(0))
    bare = F.size(F.filter(fields, lambda t: ~t.rlike(r"""(?i)\btype\s*=\s*(["'])(?:hidden|submit|button|reset|image)\1""") & ~has(t, "aria-label") & ~has(t, "aria-labelledby")))
    k.issue("field-label", 0, bare > 0, n=bare, severity="high")
    whole = F.regexp_extract_all(text, F.lit(rf"(<({CTA_TAGS})\b{END}(?:[\s\S]*?)</\2>)"), F.lit(1))
    start = lambda w: F.regexp_extract(w, r"^<[^>]*>", 0)
    inner = lambda w: F.regexp_replace(w, r"^<[^>]*>|</[^>]*>$", "")
    icons = F.size(F.filter(whole, lambda w: ~has(start(w), "aria-label") & ~has(start(w), "aria-labelledby") & ~has(start(w), "title")
        & (F.regexp_replace(inner(w), r"<[^>]*>|\{[^}]*\}|\s+", "") == "") & ~inner(w).rlike(r"""\balt\s*=\s*["'][^"']+["']|aria-label\s*=""")))
    k.issue("icon-only", 0, icons > 0, n=icons, severity="medium")
    gone = sum(((~text.rlike(p)).cast("int") for p in (r"(?i)<main\b|role\s*=\s*[\"']main", r"(?i)<nav\b|role\s*=\s*[\"']navigation", r"(?i)<footer\b|role\s*=\s*[\"']contentinfo")), F.lit(0))
    k.issue("landmarks", 0, page_level(c("path")) & (gone > 0), n=gone, severity="low")
    in_form = F.regexp_count(F.regexp_extract(text, r"(?is)<form\b.*?</form>", 0), F.lit(r"(?i)<(?:input|select|textarea)\b"))
    k.issue("form-fields", 0, in_form > 6, n=in_form, severity="low")
    return explode_findings(files, ["project", "path"], k.column())


def native_components(files: DataFrame, stacks: DataFrame) -> DataFrame:
    """Plain images and internal links in files of projects whose framework has its own components for them."""
    plain = F.regexp_count("content", F.lit(r"<img\b"))
    links = F.regexp_count("content", F.lit(r"""<a\b[^>]*\bhref\s*=\s*["']/(?!/)[^"']*["']"""))
    n_img = F.when(~c("content").rlike(r"""from\s+["']next/image["']"""), plain).otherwise(0)
    n_link = F.when(~c("content").rlike(r"""from\s+["']next/link["']"""), links).otherwise(0)
    rows = F.array(F.struct(F.lit("framework-image").alias("rule_id"), n_img.cast("long").alias("n")), F.struct(F.lit("framework-link").alias("rule_id"), n_link.cast("long").alias("n")))
    return files.join(stacks.filter(c("stack") == "next").select("project"), "project", "left_semi").select("project", "path", F.inline(rows)).filter(c("n") > 0)


def positions(files: DataFrame) -> DataFrame:
    """``ext_findings_pos``: project, path, rule_id, start and end of every match of every rule for the file.

    Lengths of matches and gaps are summed by a window per file and rule: only matches are shuffled, and a file with
    many of them costs no more for each.
    """
    kind = "array<struct<rule_id:string,at:int,step:int,size:int>>"

    def of(rule: str, pattern: str, only: str | None) -> Column:
        size = lambda x: F.length(x["match"])
        rows = F.transform(pieces(c("content"), pattern), lambda x, i: F.struct(F.lit(rule).alias("rule_id"), i.alias("at"), (F.length(x["gap"]) + size(x)).alias("step"), size(x).alias("size")))
        return F.coalesce(F.when(c("path").rlike(only), rows) if only else rows, F.array().cast(kind))

    numbered = files.select(F.monotonically_increasing_id().alias("file_no"), "project", "path", "content")
    found = numbered.select("file_no", "project", "path", F.inline(F.concat(*[of(*rule) for rule in LIVE])))
    end = F.sum("step").over(Window.partitionBy("file_no", "rule_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")
    return found.withColumn("end", end).select("project", "path", "rule_id", (c("end") - c("size")).alias("start"), "end")


def live_counts(files: DataFrame) -> DataFrame:
    """``audit_source_live``: how often each rule fires in a file; counted in the row, without positions."""
    counts = [F.when(c("path").rlike(only) if only else F.lit(True), F.struct(F.lit(rule).alias("rule_id"), F.regexp_count("content", F.lit(pattern)).cast("long").alias("n"))) for rule, pattern, only in LIVE]
    return files.select("project", "path", F.inline(F.array_compact(F.array(*counts)))).filter(c("n") > 0)


def issue_counts(findings: DataFrame) -> DataFrame:
    """``agg_file_issue_counts``: findings of every file and of every top folder, as (project, name, kind, n)."""
    folder = F.get(F.split("path", "/"), F.lit(0))
    names = F.array(F.struct(c("path").alias("name"), F.lit("file").alias("kind")), F.struct(folder.alias("name"), F.lit("folder").alias("kind")))
    return findings.select("project", F.inline(names)).groupBy("project", "name", "kind").agg(F.count(F.lit(1)).alias("n"))


def integrity(files: DataFrame) -> DataFrame:
    """``audit_fix_integrity``: why a rewrite must be rejected, NULL when it is sound.

    Closing tags are compared inside the row: names of the original with a count above the rewrite's.
    """
    n = lambda col, ch: F.length(col) - F.length(F.replace(col, F.lit(ch), F.lit("")))
    delta = lambda ch: n(c("modified"), ch) - n(c("original"), ch)
    closers = lambda col: F.transform(F.regexp_extract_all(col, F.lit(r"</([A-Za-z][\w.-]*)>"), F.lit(1)), lambda t: F.lower(t))
    f = files.withColumn("was", closers(c("original"))).withColumn("now", closers(c("modified")))
    count_in = lambda arr, t: F.size(F.filter(arr, lambda x: x == t))
    lost = F.exists(F.array_distinct("was"), lambda t: count_in(c("now"), t) < count_in(c("was"), t))
    reason = (
        F.when(c("modified") == c("original"), None).when(F.length("modified") < F.length("original"), "shrunk")
        .when(delta("<") != delta(">"), "angle-brackets").when(n(c("modified"), '"') % 2 != 0, "quotes")
        .when(c("path").rlike(r"\.(tsx|jsx)$") & (delta("{") != delta("}")), "braces").when(lost, "closing-tag"))
    return f.select("project", "path", reason.alias("reason"))


def project_stack(files: DataFrame) -> DataFrame:
    """``audit_project_stack``: framework of a project from package.json, then marker files, then extensions."""
    pkg = c("path").rlike(r"(^|/)package\.json$")
    deps_of = lambda k: F.coalesce(F.map_keys(F.from_json(F.get_json_object("content", f"$.{k}"), "map<string,string>")), F.array().cast("array<string>"))
    per_file = files.select(
        "project", "path", F.when(pkg, F.concat(deps_of("dependencies"), deps_of("devDependencies"))).alias("deps"), pkg.alias("is_pkg"))
    dep = lambda *names: F.max(F.coalesce(F.arrays_overlap("deps", F.array(*[F.lit(x) for x in names])), F.lit(False)))
    has = lambda p: F.max(c("path").rlike(p))
    kinds = [
        ("next", dep("next")), ("nuxt", dep("nuxt", "nuxt3") | has(r"(^|/)nuxt\.config\.(js|ts|mjs)$")), ("angular", dep("@angular/core") | has(r"(^|/)angular\.json$")),
        ("sveltekit", dep("@sveltejs/kit") | has(r"(^|/)svelte\.config\.(js|ts|mjs)$")), ("svelte", dep("svelte") | has(r"\.svelte$")), ("remix", dep("@remix-run/react")),
        ("astro", dep("astro") | has(r"(^|/)astro\.config\.(js|ts|mjs)$")), ("gatsby", dep("gatsby")), ("qwik", dep("@builder.io/qwik", "@builder.io/qwik-city")),
        ("solidstart", dep("solid-start") | has(r"(^|/)vite\.config\.(js|ts|mjs).*solid-start")),
        ("solid", dep("solid-js", "vite-plugin-solid") | has(r"(^|/)solid\.config\.(js|ts|mjs)$")), ("preact", dep("preact", "preact-render-to-string")),
        ("lit", dep("lit", "lit-element", "lit-html")), ("ember", dep("ember-cli", "ember-source") | has(r"(^|/)ember-cli-build\.js$")), ("vue", dep("vue") | has(r"\.vue$")),
        ("cra", dep("react-scripts")), ("vite-react", dep("vite") & dep("react")), ("react", dep("react")), ("alpine", dep("alpinejs")),
        ("next", ~F.max("is_pkg") & has(r"(^|/)app/(.*/)?layout\.(tsx|jsx)$|(^|/)pages/_app\.(tsx|jsx)$")),
        ("astro", ~F.max("is_pkg") & has(r"\.astro$")), ("react", ~F.max("is_pkg") & has(r"\.(tsx|jsx)$")),
        ("static", has(r"(?i)\.html?$")),
    ]
    out = F.lit("unknown")
    for kind, cond in reversed(kinds):
        out = F.when(cond, kind).otherwise(out)
    return per_file.groupBy("project").agg(out.alias("stack"))


def fixable(path: Column, content: Column) -> Column:
    """``flt_source_fixable``: files whose markup can be audited, by extension and content."""
    script = path.rlike(r"\.(js|mjs|cjs)$") & (content.rlike(r"<[A-Za-z][\w.-]*[\s/>]") | content.rlike(r"""target\s*=\s*["']_blank["']"""))
    typed = path.rlike(r"\.ts$") & (
        (content.rlike(r"@Component\s*\(") & content.rlike(r"template\s*:\s*`")) | content.rlike(r"(?s)\brender\s*\(\s*\)\s*\{.*?\bhtml\s*`"))
    left_out = path.rlike(r"\.d\.ts$") | path.rlike(r"(?i)(\.(test|spec|stories)\.[a-z]+$|(^|/)__tests__/)")
    return ~left_out & (path.rlike(r"\.(tsx|jsx|vue|svelte|astro|hbs)$") | script | typed)


def full_document(content: Column) -> Column:
    """``flt_full_document``"""
    return content.rlike(r"(?i)<html[\s>]|<!doctype\s+html|<head[\s>]")


def has_metadata_above(files: DataFrame) -> DataFrame:
    """``join_ancestor_metadata``: files below a folder whose layout exports metadata."""
    exports = c("content").rlike(r"export\s+(const\s+metadata\b|(async\s+)?function\s+generateMetadata\b)")
    folder = lambda p: F.regexp_replace(p, r"/?[^/]*$", "")
    layouts = files.filter(c("path").rlike(r"(^|/)layout\.(tsx|jsx)$") & exports).select("project", folder(c("path")).alias("dir"))
    segs = F.split(folder(c("path")), "/")
    above = F.transform(F.sequence(F.lit(0), F.size(segs)), lambda n: F.array_join(F.slice(segs, F.lit(1), n), "/"))
    below = files.select("project", "path", F.explode(F.array_distinct(above)).alias("dir"))
    return below.join(layouts, ["project", "dir"], "left_semi").select("project", "path").distinct()


def internal_links(files: DataFrame) -> DataFrame:
    """``join_resolve_internal_links``: distinct edges between files of a project, no self loops."""
    base = F.regexp_replace(F.regexp_replace(F.regexp_replace(c("path"), r"(?i)\.(html?|jsx?|tsx?|vue|svelte|astro)$", ""), r"(?i)/(index|page)$", ""), r"^\.?/", "")
    names = files.select("project", c("path").alias("target"), F.explode(F.array_distinct(F.array(F.when(base == "", "home").otherwise(base), c("path")))).alias("key"))
    targets = names.groupBy("project", "key").agg(F.max("target").alias("target"))
    href = F.regexp_extract_all(c("content"), F.lit(r"""\b(?:href|to)\s*=\s*["']([^"']+)["']"""), F.lit(1))
    links = files.select("project", c("path").alias("source"), F.explode(F.array_distinct(href)).alias("href")).filter(
        ~c("href").rlike(r"^(https?:)?//|^mailto:|^tel:")).withColumn("clean", F.regexp_replace("href", "[#?].*$", "")).filter(c("clean") != "")
    folder = F.regexp_replace(c("source"), "[^/]*$", "")
    joined = F.when(c("clean").startswith("/"), F.substr(c("clean"), F.lit(2))).otherwise(F.regexp_replace(F.concat(folder, c("clean")), r"(^|/)(?:\./)+", "$1"))
    keyed = links.withColumn("key", F.regexp_replace(joined, "/$", ""))
    return keyed.join(targets, ["project", "key"]).filter(c("source") != c("target")).select("project", "source", "target").distinct()


def worst_files(files: DataFrame, n: int) -> DataFrame:
    """``topk_worst_files``: the files with the most findings, beside the files and links of their projects."""
    worst = audit_files(files).groupBy("project", "path").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "project", "path").limit(n)
    nodes = files.groupBy("project").agg(F.count_distinct("path").alias("n_nodes"))
    edges = internal_links(files).groupBy("project").agg(F.count(F.lit(1)).alias("n_edges"))
    sized = nodes.join(edges, "project", "left").select("project", "n_nodes", F.coalesce("n_edges", F.lit(0)).cast("long").alias("n_edges"))
    return worst.join(sized, "project").select("project", "path", "n", "n_nodes", "n_edges")


# Weight of a project finding by severity.
PROJECT_WEIGHTS = {"critical": 16, "high": 10, "medium": 6, "low": 3, "informational": 1, "good": 0}


def affected_files(findings: DataFrame) -> DataFrame:
    """``agg_affected_files``: distinct files per finding, with the project weight of its severity."""
    weight = F.coalesce(*[F.when(c("severity") == s, w) for s, w in PROJECT_WEIGHTS.items()])
    per_file = findings.groupBy("project", "rule_id", "path").agg(F.max("severity").alias("severity"))
    return per_file.groupBy("project", "rule_id").agg(F.count(F.lit(1)).alias("n_files"), F.min("path").alias("first_path"), F.max(weight).alias("weight"))


def project_wide(files: DataFrame) -> DataFrame:
    """``audit_project_wide``: which site-wide files a project has."""
    has = lambda p: F.max(c("path").rlike(p))
    return files.groupBy("project").agg(
        has(r"(^|/)robots\.(txt|ts|js)$").alias("has_robots"), has(r"(^|/)sitemap(\.xml|\.ts|\.js)$").alias("has_sitemap"),
        has(r"(^|/)(next\.config\.(js|mjs|ts)|vercel\.json|netlify\.toml|_headers|\.htaccess)$").alias("has_headers_config"))
