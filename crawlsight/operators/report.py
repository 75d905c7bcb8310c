"""The report of a scan as whole documents: CSV, TSV, Markdown, YAML, text and JSON.

A document is a table of lines with their place in it: head, categories, issues, passed checks, pages. The first four are
as small as the rule list; pages are as many as were scanned, so lines are sorted by range and written as files that
follow each other, never gathered in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlsight.functions import text as T
from crawlsight.operators import score as S
from crawlsight.operators.page_rules import PAGE_CATEGORIES
from crawlsight.session import stored

c = F.col
PLACE = ["part", "k1", "k2", "k3"]
BAND = "CASE WHEN overall >= 80 THEN 'Good' WHEN overall >= 60 THEN 'Needs work' ELSE 'Critical' END"


class Report:
    """The tables of a report. ``resolved`` is (category, rule_id) of the issues that have been settled since."""

    def __init__(self, audited: DataFrame, findings: DataFrame, resolved: DataFrame, site: str, day: str) -> None:
        self.site, self.day = site, day
        done = resolved.select("category", "rule_id", F.lit(True).alias("done")).distinct()
        per_page = S.page_category_scores(audited)
        issues = S.card_issues(findings).join(done, ["category", "rule_id"], "left")
        self.issues = stored(issues.select("category", S.label(c("category")).alias("label"), "rule_id", "severity", F.when(c("done"), "Resolved").otherwise("Open").alias("status"), "weight", "n_affected"), "report-issues")
        self.passed = stored(S.card_passed(findings).select("category", S.label(c("category")).alias("label"), "rule_id"), "report-passed")
        counts = self.issues.groupBy("category").agg(F.count_if(c("status") == "Open").alias("open_issues"), F.count(F.lit(1)).alias("total_issues"))
        checks = self.passed.groupBy("category").agg(F.count(F.lit(1)).alias("passed_count"))
        zero = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("open_issues", "total_issues", "passed_count")]
        scores = S.category_scores(per_page).join(counts, "category", "left").join(checks, "category", "left")
        self.categories = stored(scores.select("category", S.label(c("category")).alias("label"), "score", *zero, "pages_analyzed"), "report-categories")
        self.overall = self.categories.agg(F.round(F.avg("score")).cast("int").alias("overall"), F.sum("total_issues").alias("n"), F.max("pages_analyzed").alias("pages"))
        by_page = per_page.groupBy("page_id", "url").agg(F.min("depth").alias("depth"), F.round(F.avg("score")).cast("int").alias("score"), *[F.max(F.when(c("category") == k, c("score"))).alias(k) for k in PAGE_CATEGORIES])
        self.pages = stored(by_page, "report-pages")

    def lines(self, part: int, rows: DataFrame, keys: list[Column], *texts: Column) -> DataFrame:
        """A line for each of ``texts`` that is not null, in their order, for every row; rows go by ``keys``."""
        place = [F.lit(part).alias("part"), *[(keys[i] if i < len(keys) else F.lit("")).cast("string").alias(f"k{i + 1}") for i in range(2)]]
        return rows.select(*place, F.posexplode(F.array(*texts)).alias("k3", "line")).filter(c("line").isNotNull())

    def fixed(self, part: int, *texts: str | Column) -> DataFrame:
        return self.lines(part, self.overall, [], *[F.lit(t) if isinstance(t, str) else t for t in texts])


def heaviest_first(weight: Column) -> Column:
    return F.lpad((F.lit(100000) - weight).cast("string"), 6, "0")


def padded(number: Column) -> Column:
    return F.lpad(number.cast("string"), 20, "0")


def delimited(r: Report, escape, separator: str) -> list[DataFrame]:
    """``sink_csv`` / ``sink_tsv``: blocks with their own header rows."""
    row = lambda *cells: F.concat_ws(separator, *[escape(F.coalesce(x.cast("string"), F.lit(""))) for x in cells])
    head = lambda *names: separator.join(names)
    title = F.concat(F.lit(f"# Site: {r.site} | Overall score: "), c("overall").cast("string"), F.lit(f"/100 | Generated: {r.day}"))
    labels = [S.LABELS[k] for k in PAGE_CATEGORIES]
    return [
        r.fixed(0, title, "", head("Category", "Score", "Open Issues", "Total Issues", "Passed Checks", "Pages Analyzed")),
        r.lines(1, r.categories, [c("label")], row(c("label"), c("score"), c("open_issues"), c("total_issues"), c("passed_count"), c("pages_analyzed"))),
        r.fixed(2, "", "# Issues", "", head("Category", "Severity", "Status", "Issue ID", "Weight", "Affected")),
        r.lines(3, r.issues, [heaviest_first(c("weight")), F.concat("rule_id", F.lit(" "), "category")], row(c("label"), c("severity"), c("status"), c("rule_id"), c("weight"), c("n_affected"))),
        r.fixed(4, "", "# Passed checks", "", head("Category", "Passed Check")),
        r.lines(5, r.passed, [c("label"), c("rule_id")], row(c("label"), c("rule_id"))),
        r.fixed(6, "", "# Per-page scores", "", head("Page URL", "Depth", "Overall Score", *labels)),
        r.lines(7, r.pages, [c("url"), padded(c("page_id"))], row(c("url"), c("depth"), c("score"), *map(c, PAGE_CATEGORIES))),
    ]


def markdown(r: Report) -> list[DataFrame]:
    """``sink_markdown``"""
    text = lambda *xs: F.concat(*[x.cast("string") if isinstance(x, Column) else F.lit(x) for x in xs])
    first = lambda rows: rows.select("label").distinct()
    return [
        r.fixed(0, "# Audit report", "", f"**Site:** {r.site}", f"**Generated:** {r.day}", text("**Overall score:** ", c("overall"), "/100 (", F.expr(BAND), ")"), "", text("Scanned ", c("pages"), " pages."), "",
                "## Category scores", "", "| Category | Score | Open issues | Total issues | Passed checks |", "|---|---|---|---|---|"),
        r.lines(1, r.categories, [c("label")], text("| ", c("label"), " | ", c("score"), "/100 | ", c("open_issues"), " | ", c("total_issues"), " | ", c("passed_count"), " |")),
        r.fixed(2, "", "## Issues"),
        r.lines(3, first(r.issues), [c("label")], F.lit(""), text("### ", c("label")), F.lit("")),
        r.lines(3, r.issues, [c("label"), F.concat(heaviest_first(c("weight")), "rule_id")], text("- **[", F.upper("severity"), "] ", c("rule_id"), "** — ", c("status"), " (", c("n_affected"), ")")),
        r.fixed(4, "", "## Passed checks"),
        r.lines(5, first(r.passed), [c("label")], F.lit(""), text("### ", c("label")), F.lit("")),
        r.lines(5, r.passed, [c("label"), F.concat(F.lit("-"), "rule_id")], text("- ", c("rule_id"))),
        r.fixed(6, "", "## Per-page scores", "", "| Page | Depth | Overall | " + " | ".join(S.LABELS[k] for k in PAGE_CATEGORIES) + " |", "|" + "---|" * (3 + len(PAGE_CATEGORIES))),
        r.lines(7, r.pages, [c("url"), padded(c("page_id"))], text("| ", c("url"), " | ", c("depth"), " | ", F.concat_ws(" | ", c("score").cast("string"), *[c(k).cast("string") for k in PAGE_CATEGORIES]), " |")),
    ]


def plain(r: Report) -> list[DataFrame]:
    """``sink_txt``"""
    text = lambda *xs: F.concat(*[x.cast("string") if isinstance(x, Column) else F.lit(x) for x in xs])
    bar, line = "=" * 70, "-" * 70
    return [
        r.fixed(0, bar, "AUDIT REPORT", bar, "", f"Site:          {r.site}", f"Generated:     {r.day}", text("Overall score: ", c("overall"), "/100 (", F.expr(BAND), ")"), text("Pages scanned: ", c("pages")), "", line, "CATEGORY SCORES", line, ""),
        r.lines(1, r.categories, [c("label")], text(F.rpad("label", 28, " "), " ", F.lpad(c("score").cast("string"), 3, " "), "/100   open: ", c("open_issues"), ", total: ", c("total_issues"), ", passed: ", c("passed_count"))),
        r.fixed(2, "", line, "ISSUES", line),
        r.lines(3, r.issues.select("label").distinct(), [c("label")], F.lit(""), text("[", c("label"), "]"), F.lit("")),
        r.lines(3, r.issues, [c("label"), F.concat(heaviest_first(c("weight")), "rule_id")], text("- (", F.upper("severity"), ", ", c("status"), ") ", c("rule_id"))),
        r.fixed(4, "", line, "PASSED CHECKS", line),
        r.lines(5, r.passed.select("label").distinct(), [c("label")], F.lit(""), text("[", c("label"), "]"), F.lit("")),
        r.lines(5, r.passed, [c("label"), F.concat(F.lit("-"), "rule_id")], text("- ", c("rule_id"))),
    ]


def yaml(r: Report) -> list[DataFrame]:
    """``sink_yaml``: strings are quoted, so that none reads as another kind of value."""
    strings = ("label", "id", "severity", "status", "url", "category")

    def item(**cells: Column) -> list[Column]:
        value = {k: F.concat(F.lit("'"), F.replace(v, F.lit("'"), F.lit("''")), F.lit("'")) if k in strings else v.cast("string") for k, v in cells.items()}
        return [F.concat(F.lit(f"{'    ' if i else '  - '}{k}: "), v) for i, (k, v) in enumerate(value.items())]

    return [
        r.fixed(0, "# Audit report", f"site: '{r.site}'", f"generated: '{r.day}'", F.concat(F.lit("overall_score: "), c("overall").cast("string")), "categories:"),
        r.lines(1, r.categories, [c("label")], *item(label=c("label"), score=c("score"), open_issues=c("open_issues"), total_issues=c("total_issues"), passed_checks=c("passed_count"), pages_analyzed=c("pages_analyzed"))),
        r.fixed(2, "issues:"),
        r.lines(3, r.issues, [heaviest_first(c("weight")), F.concat("rule_id", F.lit(" "), "category")], *item(id=c("rule_id"), category=c("label"), severity=c("severity"), status=c("status"), weight=c("weight"), affected=c("n_affected"))),
        r.fixed(4, "passed_checks:"),
        r.lines(5, r.passed, [c("label"), c("rule_id")], *item(id=c("rule_id"), category=c("label"))),
        r.fixed(6, "pages:"),
        r.lines(7, r.pages, [c("url"), padded(c("page_id"))], *item(url=c("url"), depth=c("depth"), score=c("score"), **{k: c(k) for k in PAGE_CATEGORIES})),
    ]


def json(r: Report) -> list[DataFrame]:
    """``sink_json``: one object; every line holds one element of its lists, and a list's last one has no comma."""

    def elements(part: int, rows: DataFrame, keys: list[Column], *fields: str) -> DataFrame:
        place = F.struct(*[k.cast("string").alias(f"p{i}") for i, k in enumerate(keys)])
        last = rows.agg(F.max(place).alias("last"))  # one row
        comma = F.when(place == c("last"), "").otherwise(",")
        return r.lines(part, rows.join(F.broadcast(last)), keys, F.concat(F.to_json(F.struct(*fields)), comma))

    return [
        r.fixed(0, F.concat(F.lit(f'{{"site":"{r.site}","generated":"{r.day}","overall_score":'), c("overall").cast("string"), F.lit(',"categories":['))),
        elements(1, r.categories, [c("label")], "label", "score", "open_issues", "total_issues", "passed_count", "pages_analyzed"),
        r.fixed(2, '],"issues":['),
        elements(3, r.issues, [heaviest_first(c("weight")), F.concat("rule_id", F.lit(" "), "category")], "label", "rule_id", "severity", "status", "weight", "n_affected"),
        r.fixed(4, '],"passed_checks":['),
        elements(5, r.passed, [c("label"), c("rule_id")], "label", "rule_id"),
        r.fixed(6, '],"pages":['),
        elements(7, r.pages, [c("url"), padded(c("page_id"))], "url", "depth", "score", *PAGE_CATEGORIES),
        r.fixed(8, "]}"),
    ]


FORMATS = {
    "csv": lambda r: delimited(r, T.escape_csv, ","),
    "tsv": lambda r: delimited(r, T.escape_tsv, "\t"),
    "markdown": markdown,
    "txt": plain,
    "yaml": yaml,
    "json": json,
}


def document(report: Report, kind: str) -> DataFrame:
    """The lines of a document, in order: part, k1, k2, k3, line."""
    return reduce(DataFrame.unionByName, FORMATS[kind](report)).orderBy(*PLACE)


def write(report: Report, kind: str, out: str) -> None:
    """The document as text files that follow each other by name."""
    document(report, kind).select("line").write.mode("overwrite").text(out)
