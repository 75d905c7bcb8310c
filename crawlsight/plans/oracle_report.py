"""DuckDB twins of the report documents, over cs (categories), ci (issues), fx (findings) and pcs (page scores)."""

from __future__ import annotations

from crawlsight.operators.page_rules import PAGE_CATEGORIES
from crawlsight.operators.score import LABELS

_NAMES = [LABELS[k] for k in PAGE_CATEGORIES]
LABEL = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABELS.items()) + " END"
MODEL = f"""
iss AS (SELECT {LABEL} AS label, category, rule_id, severity, CASE WHEN contains(rule_id, 'alt') THEN 'Resolved' ELSE 'Open' END AS status, weight, n_affected FROM ci),
pas AS (SELECT DISTINCT {LABEL} AS label, category, rule_id FROM fx a WHERE passed AND NOT EXISTS (SELECT 1 FROM fx b WHERE NOT b.passed AND b.category = a.category AND b.rule_id = a.rule_id)),
cat_rows AS (SELECT {LABEL} AS label, score, (SELECT count(*) FROM iss WHERE iss.category = cs.category AND status = 'Open') AS open_issues, (SELECT count(*) FROM iss WHERE iss.category = cs.category) AS total_issues,
  (SELECT count(*) FROM pas WHERE pas.category = cs.category) AS passed_count, pages_analyzed FROM cs),
pg AS (SELECT page_id, url, min(depth) AS depth, CAST(round(avg(score)) AS INT) AS score, {', '.join(f"max(score) FILTER (category = '{k}') AS {k}" for k in PAGE_CATEGORIES)} FROM pcs GROUP BY page_id, url),
ov AS (SELECT CAST(round(avg(score)) AS INT) AS overall, max(pages_analyzed) AS pages FROM cat_rows)"""
BAND = "CASE WHEN overall >= 80 THEN 'Good' WHEN overall >= 60 THEN 'Needs work' ELSE 'Critical' END"


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _fixed(*texts: str) -> str:
    return "SELECT unnest([" + ", ".join(_q(t) for t in texts) + "]) AS line"


def _csv(x: str) -> str:
    return f"""CASE WHEN regexp_matches({x}, '[",\\n\\r]') THEN '"' || replace({x}, '"', '""') || '"' ELSE {x} END"""


def _delimited(site: str, day: str, sep: str, escape) -> list[str]:
    row = lambda *cells: " || chr(9) || ".join(escape(f"CAST({x} AS VARCHAR)") for x in cells) if sep == "\t" else " || ',' || ".join(f"({escape(f'CAST({x} AS VARCHAR)')})" for x in cells)
    head = lambda *names: "array_to_string([" + ", ".join(_q(n) for n in names) + "], " + ("chr(9)" if sep == "\t" else "','") + ")"
    return [
        f"SELECT '# Site: {site} | Overall score: ' || overall || '/100 | Generated: {day}' FROM ov",
        _fixed("", "", "# Issues", "", "", "# Passed checks", "", "", "# Per-page scores", ""),
        f"SELECT unnest([{head('Category', 'Score', 'Open Issues', 'Total Issues', 'Passed Checks', 'Pages Analyzed')}, {head('Category', 'Severity', 'Status', 'Issue ID', 'Weight', 'Affected')}, {head('Category', 'Passed Check')}, {head('Page URL', 'Depth', 'Overall Score', *_NAMES)}])",
        f"SELECT {row('label', 'score', 'open_issues', 'total_issues', 'passed_count', 'pages_analyzed')} FROM cat_rows",
        f"SELECT {row('label', 'severity', 'status', 'rule_id', 'weight', 'n_affected')} FROM iss",
        f"SELECT {row('label', 'rule_id')} FROM pas",
        f"SELECT {row('url', 'depth', 'score', *PAGE_CATEGORIES)} FROM pg",
    ]


def _markdown(site: str, day: str) -> list[str]:
    return [
        _fixed("# Audit report", "", f"**Site:** {site}", f"**Generated:** {day}", "", "", "## Category scores", "", "| Category | Score | Open issues | Total issues | Passed checks |", "|---|---|---|---|---|", "", "## Issues", "", "## Passed checks", "", "## Per-page scores", "",
               "| Page | Depth | Overall | " + " | ".join(_NAMES) + " |", "|" + "---|" * (3 + len(_NAMES))),
        f"SELECT '**Overall score:** ' || overall || '/100 (' || {BAND} || ')' FROM ov UNION ALL SELECT 'Scanned ' || pages || ' pages.' FROM ov",
        "SELECT '| ' || label || ' | ' || score || '/100 | ' || open_issues || ' | ' || total_issues || ' | ' || passed_count || ' |' FROM cat_rows",
        "SELECT unnest(['', '### ' || label, '']) FROM (SELECT DISTINCT label FROM iss)",
        "SELECT '- **[' || upper(severity) || '] ' || rule_id || '** — ' || status || ' (' || n_affected || ')' FROM iss",
        "SELECT unnest(['', '### ' || label, '']) FROM (SELECT DISTINCT label FROM pas)",
        "SELECT '- ' || rule_id FROM pas",
        f"SELECT '| ' || url || ' | ' || depth || ' | ' || concat_ws(' | ', score, {', '.join(PAGE_CATEGORIES)}) || ' |' FROM pg",
    ]


def _txt(site: str, day: str) -> list[str]:
    bar, line = "=" * 70, "-" * 70
    return [
        _fixed(bar, "AUDIT REPORT", bar, "", f"Site:          {site}", f"Generated:     {day}", "", line, "CATEGORY SCORES", line, "", "", line, "ISSUES", line, "", line, "PASSED CHECKS", line),
        f"SELECT 'Overall score: ' || overall || '/100 (' || {BAND} || ')' FROM ov UNION ALL SELECT 'Pages scanned: ' || pages FROM ov",
        "SELECT rpad(label, 28, ' ') || ' ' || lpad(score::VARCHAR, 3, ' ') || '/100   open: ' || open_issues || ', total: ' || total_issues || ', passed: ' || passed_count FROM cat_rows",
        "SELECT unnest(['', '[' || label || ']', '']) FROM (SELECT DISTINCT label FROM iss)",
        "SELECT '- (' || upper(severity) || ', ' || status || ') ' || rule_id FROM iss",
        "SELECT unnest(['', '[' || label || ']', '']) FROM (SELECT DISTINCT label FROM pas)",
        "SELECT '- ' || rule_id FROM pas",
    ]


def _yaml(site: str, day: str) -> list[str]:
    def items(table: str, **cells: str) -> str:
        text = {"label", "id", "severity", "status", "url", "category"}
        values = [f"'{'  - ' if i == 0 else '    '}{k}: ' || " + (f"'''' || replace({v}, '''', '''''') || ''''" if k in text else v) for i, (k, v) in enumerate(cells.items())]
        return f"SELECT unnest([{', '.join(values)}]) FROM {table}"

    return [
        _fixed("# Audit report", f"site: '{site}'", f"generated: '{day}'", "categories:", "issues:", "passed_checks:", "pages:"),
        "SELECT 'overall_score: ' || overall FROM ov",
        items("cat_rows", label="label", score="score", open_issues="open_issues", total_issues="total_issues", passed_checks="passed_count", pages_analyzed="pages_analyzed"),
        items("iss", id="rule_id", category="label", severity="severity", status="status", weight="weight", affected="n_affected"),
        items("pas", id="rule_id", category="label"),
        items("pg", url="url", depth="depth", score="score", **{k: k for k in PAGE_CATEGORIES}),
    ]


def _json(site: str, day: str) -> list[str]:
    def items(table: str, order: str, *fields: str) -> str:
        made = " || ',' || ".join(f"""'"{f}":' || to_json({f})""" for f in fields)
        return f"SELECT '{{' || {made} || '}}' || CASE WHEN row_number() OVER (ORDER BY {order}) = count(*) OVER () THEN '' ELSE ',' END FROM {table}"

    return [
        _fixed('],"issues":[', '],"passed_checks":[', '],"pages":[', "]}"),
        f"""SELECT '{{"site":"{site}","generated":"{day}","overall_score":' || overall || ',"categories":[' FROM ov""",
        items("cat_rows", "label", "label", "score", "open_issues", "total_issues", "passed_count", "pages_analyzed"),
        items("iss", "weight DESC, rule_id || ' ' || category", "label", "rule_id", "severity", "status", "weight", "n_affected"),
        items("pas", "label, rule_id", "label", "rule_id"),
        items("pg", "url, page_id", "url", "depth", "score", *PAGE_CATEGORIES),
    ]


def document(kind: str, site: str, day: str) -> str:
    tsv = lambda x: f"regexp_replace({x}, '[\\t\\r\\n]', ' ', 'g')"
    parts = {"csv": lambda: _delimited(site, day, ",", _csv), "tsv": lambda: _delimited(site, day, "\t", tsv), "markdown": lambda: _markdown(site, day), "txt": lambda: _txt(site, day), "yaml": lambda: _yaml(site, day), "json": lambda: _json(site, day)}[kind]()
    return f", {MODEL}\n" + "\nUNION ALL ".join(f"SELECT * FROM ({p}) x(line)" for p in parts)
