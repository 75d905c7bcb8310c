"""Pages as element trees: elements with parent, path and text, sections, findings by element, and repairs as edits.

A page is read once, token by token, with a stack of open elements and HTML's rules for end tags that may be left out.
What a parser would move or invent (implied ``html``, ``head`` and ``tbody``, misnested formatting) stays as written.
Pages are independent, so all of it is map-only: a page's row goes in, its elements, sections or edits come out. Every
step is linear in the page.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col

PLAIN = re.compile(r"""<[a-z/!](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^<]++|<""", re.I)
#: Tokens that run to an end of their own: how they begin and end.
WHOLE = [(re.compile(a, re.I), re.compile(b, re.I)) for a, b in (("<!--", "-->"), (r"<script\b[^>]*+>", r"</script\s*+>"), (r"<style\b[^>]*+>", r"</style\s*+>"))]
NAME = re.compile(r"</?([a-z][a-z0-9:-]*)", re.I)
ATTRIBUTE = re.compile(r"""[\s/]+([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'<>=`]+))?""")
SPACE = re.compile(r"\s+")

# Elements without content, what ends a paragraph, and what ends what else by opening.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
ENDS_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "main menu nav ol p pre search section summary table ul".split()
)
ENDED_BY = {
    "p": ENDS_P, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"}, "optgroup": {"optgroup"}, "rt": {"rt", "rp"},
    "rp": {"rt", "rp"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "tr": {"tr", "tbody", "tfoot"},
    "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}, "head": {"body"},
}
#: An element out of whose inside nothing ends what is open around it.
WALLS = {"button", "caption", "html", "marquee", "object", "table", "td", "template", "th"}
LIST_WALLS = {"li": {"ol", "ul", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "thead": {"table"}}
# Words of links that say nothing, and twitter cards that exist.
GENERIC = ("submit", "click here", "here", "go", "learn more", "read more")
CARDS = {"summary", "summary_large_image", "app", "player"}


def tokens(source: str) -> Iterator[tuple[int, int]]:
    """Start and end of every token. What opens behind the last end of its kind is a plain tag, so no end is sought twice."""
    last = [max((m.start() for m in end.finditer(source)), default=-1) for _, end in WHOLE]
    at = 0
    while at < len(source):
        stop = 0
        if source[at] == "<":
            for (begin, end), limit in zip(WHOLE, last, strict=True):
                if (m := begin.match(source, at)) and m.end() <= limit:
                    stop = end.search(source, m.end()).end()
                    break
        stop = stop or PLAIN.match(source, at).end()
        yield at, stop
        at = stop


@dataclass
class Element:
    node: int
    parent: int
    tag: str
    nth: int
    start: int
    inside: int
    opening: str
    attrs: dict[str, str]
    text_from: int
    text_to: int = 0
    end: int = 0
    stop: int = 0
    of_tag: dict[str, int] = field(default_factory=dict)


def attributes(opening: str) -> dict[str, str]:
    """Names in lower case, values decoded; the first of equal names counts."""
    out: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(opening, NAME.match(opening).end(), len(opening) - 1):
        out.setdefault(name.lower(), entities.unescape(value[1:-1] if value[:1] in "\"'" else value))
    return out


class Page:
    """The elements of a page in the order of their opening tags, and its text."""

    def __init__(self, source: str | None) -> None:
        self.source = source or ""
        self.elements: list[Element] = []
        self.text = ""
        self._parse()

    def _parse(self) -> None:
        stack: list[Element] = []
        places: dict[str, list[int]] = {}  # of each tag, where in the stack it is open
        tops: dict[str, int] = {}
        parts: list[str] = []
        length = 0

        def close(to: int, end: int, stop: int) -> None:
            while len(stack) > to:
                e = stack.pop()
                places[e.tag].pop()
                e.text_to, e.end = length, end
                e.stop = stop if len(stack) == to else end

        def find(tag: str, walls: set[str]) -> int:
            own = places.get(tag)
            if not own or any(at[-1] > own[-1] for w in walls if w != tag and (at := places.get(w))):
                return -1
            return own[-1]

        for at, behind in tokens(self.source):
            token = self.source[at:behind]
            if token[0] != "<" or token == "<":
                text = entities.unescape(token)
                parts.append(text)
                length += len(text)
                continue
            if token.startswith("<!"):
                continue
            name = NAME.match(token)
            if name is None:
                continue
            tag = name[1].lower()
            if token.startswith("</"):
                walls = set() if tag in WALLS or tag in ("body", "head") else WALLS
                if (i := find(tag, walls)) >= 0:
                    close(i, at, behind)
                continue
            for open_tag, ending in ENDED_BY.items():
                if tag in ending and (i := find(open_tag, LIST_WALLS.get(open_tag, WALLS))) >= 0:
                    close(i, at, at)
            over = stack[-1] if stack else None
            counts = over.of_tag if over else tops
            nth = counts[tag] = counts.get(tag, 0) + 1
            opening = token if not token.lower().startswith(("<script", "<style")) else token[: token.index(">") + 1]
            e = Element(len(self.elements), over.node if over else -1, tag, nth, at, at + len(opening), opening, attributes(opening), length)
            self.elements.append(e)
            if tag in VOID or tag in ("script", "style") or opening.endswith("/>"):
                e.text_to, e.end, e.stop = length, behind, behind
            else:
                places.setdefault(tag, []).append(len(stack))
                stack.append(e)
        close(0, len(self.source), len(self.source))
        self.text = "".join(parts)

    def text_of(self, e: Element) -> str:
        return self.text[e.text_from : e.text_to]

    def path(self, e: Element) -> str:
        """Tags from the top, each with its number among its kind, as ``body[1]/p[2]``."""
        steps = []
        while True:
            steps.append(f"{e.tag}[{e.nth}]")
            if e.parent < 0:
                return "/".join(reversed(steps))
            e = self.elements[e.parent]

    def first(self, tag: str, **attrs: str) -> Element | None:
        return next((e for e in self.elements if e.tag == tag and all(e.attrs.get(k.replace("_", "-")) == v for k, v in attrs.items())), None)

    def sections(self) -> list[tuple[Element, int]]:
        """Each h2 and h3 with the words of its later siblings up to the next h2 or h3 among them, or their parent's end.

        As in a browser the siblings' texts are strung together; text between siblings is no element and not counted.
        """
        current: dict[int, int] = {}
        found: list[tuple[Element, list[str]]] = []
        for e in self.elements:
            if e.tag in ("h2", "h3"):
                current[e.parent] = len(found)
                found.append((e, []))
            elif e.parent in current:
                found[current[e.parent]][1].append(self.text_of(e))
        return [(e, len("".join(parts).split())) for e, parts in found]

    def labelled(self) -> set[int]:
        """Nodes of form fields that a label names or holds, or that name themselves."""
        named = {e.attrs["for"] for e in self.elements if e.tag == "label" and e.attrs.get("for")}
        held, out = set(), set()
        for e in self.elements:
            if e.tag == "label" or e.parent in held:
                held.add(e.node)
            if e.node in held or e.attrs.get("id") in named or e.attrs.get("aria-label") or e.attrs.get("aria-labelledby"):
                out.add(e.node)
        return out

    def fields(self) -> list[Element]:
        return [e for e in self.elements if e.tag in ("select", "textarea") or e.tag == "input" and e.attrs.get("type", "").lower() not in ("hidden", "submit", "button")]


def findings(page: Page) -> list[tuple[str, Element | None]]:
    """``audit_element_annotations``: rules with the element that breaks them, or without one for the page as a whole."""
    out: list[tuple[str, Element | None]] = []
    labelled, level, n_h1 = page.labelled(), 0, 0
    for e in page.elements:
        a = e.attrs
        if e.tag == "img":
            alt = a.get("alt", "").strip()
            if not alt:
                out.append(("img-alt", e))
            elif re.search("spacer|divider|decoration", a.get("src", "")):
                out.append(("img-decorative-alt", e))
        if e.tag in ("a", "button"):
            text = page.text_of(e).strip()
            if not text and (e.tag == "button" or a.get("role") == "button") and not (a.get("aria-label") or a.get("aria-labelledby") or a.get("title")):
                out.append(("control-name", e))
            if text.lower() in GENERIC:
                out.append(("generic-cta", e))
        if re.fullmatch("h[1-6]", e.tag):
            own, n_h1 = int(e.tag[1]), n_h1 + (e.tag == "h1")
            if own == 1 and n_h1 > 1:
                out.append(("h1-extra", e))
            if level and own - level > 1:
                out.append(("heading-skip", e))
            level = own
    out += [("field-label", e) for e in page.fields() if e.node not in labelled]
    content = lambda name: (e := page.first("meta", name=name)) is not None and e.attrs.get("content", "") or ""
    title, link, root = page.first("title"), page.first("link", rel="canonical"), page.first("html")
    viewport, tags = content("viewport"), {e.tag for e in page.elements}
    whole = {
        "title-missing": not (title and page.text_of(title).strip()),
        "description-missing": not content("description").strip(),
        "canonical-missing": not (link and link.attrs.get("href")),
        "h1-missing": n_h1 == 0,
        "lang-missing": not (root and root.attrs.get("lang")),
        "viewport-missing": not viewport,
        "zoom-disabled": bool(re.search(r"user-scalable=no|maximum-scale=1(\.0)?\b", viewport)),
        "landmarks-missing": not {"main", "nav", "footer"} <= tags,
        "noindex": "noindex" in content("robots").lower(),
    }
    return out + [(rule, None) for rule, hit in whole.items() if hit]


def escaped(value: str) -> str:
    return value.replace("&", "&amp;").replace('"', "&quot;").replace("<", "&lt;").replace(">", "&gt;")


class Edits:
    """Replacements (start, end, text) of a page. What overlaps an earlier one is left out; all are applied in one pass."""

    def __init__(self, page: Page) -> None:
        self.page, self.list = page, []

    def add(self, start: int, end: int, text: str) -> None:
        self.list.append((start, end, text))

    def set(self, e: Element, name: str, value: str) -> None:
        """An attribute's value: in its place, or in front of the tag's end."""
        for m in ATTRIBUTE.finditer(e.opening, NAME.match(e.opening).end(), len(e.opening) - 1):
            if m[1].lower() == name:
                a, b = m.span(2) if m[2] is not None else (m.end(1), m.end(1))
                return self.add(e.start + a, e.start + b, f'"{escaped(value)}"' if m[2] is not None else f'="{escaped(value)}"')
        end = e.inside - (2 if e.opening.endswith("/>") else 1)
        return self.add(end, end, f" {name}" if value == "" and name == "defer" else f' {name}="{escaped(value)}"')

    def applied(self) -> str:
        out, at = [], 0
        for start, end, text in sorted(self.list, key=lambda x: x[:2]):
            if start >= at:
                out += [self.page.source[at:start], text]
                at = end
        return "".join([*out, self.page.source[at:]])


def slug_words(address: str) -> str:
    """The last part of an address as words."""
    last = next((p for p in reversed(address.split("/")) if p), "")
    return SPACE.sub(" ", re.sub(r"[-_+]+|%20", " ", re.sub(r"\.[a-z0-9]+$|[?#].*$", "", last, flags=re.I))).strip()


def repairs(page: Page, url: str) -> Edits:
    """Every repair that needs no written value, in one list of edits."""
    edits, head = Edits(page), []
    content = lambda key, name: (e.attrs.get("content", "") if (e := page.first("meta", **{key: name})) else "")
    title = page.text_of(e).strip() if (e := page.first("title")) else ""
    description = content("name", "description").strip()
    # headings: one first level, and no level more than one below the one before
    level, n_h1 = 0, 0
    for e in page.elements:
        if re.fullmatch("h[1-6]", e.tag):
            own = int(e.tag[1])
            n_h1 += own == 1
            new = 2 if own == 1 and n_h1 > 1 else own
            level = level + 1 if level and new - level > 1 else new
            if level != own:
                edits.add(e.start + 1, e.start + 3, f"h{level}")
                if e.stop > e.end:
                    edits.add(e.end + 2, e.end + 4, f"h{level}")
    link = page.first("link", rel="canonical")
    if not (link and link.attrs.get("href")):
        head.append(f'<link rel="canonical" href="{escaped(url)}">')
    elif not urlsplit(link.attrs["href"]).scheme:
        edits.set(link, "href", urljoin(url, link.attrs["href"]))
    charset = any(e.tag == "meta" and ("charset" in e.attrs or e.attrs.get("http-equiv", "").lower() == "content-type" and "charset" in e.attrs.get("content", "").lower()) for e in page.elements)
    if not any(e.tag == "link" and e.attrs.get("rel") in ("icon", "shortcut icon") for e in page.elements):
        head.append('<link rel="icon" href="/favicon.ico">')
    if page.first("link", rel="apple-touch-icon") is None:
        head.append('<link rel="apple-touch-icon" href="/apple-touch-icon.png">')
    meta = lambda key, name, value: head.append(f'<meta {key}="{name}" content="{escaped(value)}">')
    for name, value in (("title", title), ("description", description), ("url", url), ("type", "website"), ("site_name", urlsplit(url).hostname or "")):
        if value and not content("property", f"og:{name}"):
            meta("property", f"og:{name}", value)
    image = content("property", "og:image")
    shown = next((e.attrs["src"] for e in page.elements if e.tag == "img" and e.attrs.get("src") and not re.search("spacer|divider|decoration|icon|logo", e.attrs["src"], re.I)), "")
    if not image and shown:
        image = urljoin(url, shown)
        meta("property", "og:image", image)
    card = page.first("meta", name="twitter:card")
    if card is None or not card.attrs.get("content"):
        if image or title or content("property", "og:title"):
            meta("name", "twitter:card", "summary_large_image")
            for name, value in (("title", title), ("description", description), ("image", image)):
                if value:
                    meta("name", f"twitter:{name}", value)
    elif card.attrs["content"] not in CARDS:
        edits.set(card, "content", "summary_large_image")
    if not any(e.tag == "script" and e.attrs.get("type") == "application/ld+json" or "itemscope" in e.attrs for e in page.elements):
        schema = {"@context": "https://schema.org", "@type": "WebSite", "url": url} | ({"name": title} if title else {})
        head.append(f'<script type="application/ld+json">{json.dumps(schema, ensure_ascii=False, separators=(",", ":")).replace("</", "<\\/")}</script>')
    root, viewport = page.first("html"), page.first("meta", name="viewport")
    if root and not root.attrs.get("lang"):
        edits.set(root, "lang", "en")
    shown = viewport.attrs.get("content", "") if viewport else ""
    if not shown:
        head.append('<meta name="viewport" content="width=device-width, initial-scale=1">')
    elif re.search(r"user-scalable=no|maximum-scale=1(\.0)?\b", shown):
        free = re.sub(r"^,\s*", "", re.sub(r",?\s*user-scalable=no|,?\s*maximum-scale=1(\.0)?\b", "", shown, flags=re.I))
        edits.set(viewport, "content", free or "width=device-width, initial-scale=1")
    box, n_img = page.first("head"), 0
    for e in page.elements:
        a = e.attrs
        if e.tag == "script" and a.get("src") is not None and box and box.start < e.start < box.stop and not {"async", "defer"} & a.keys() and "module" not in a.get("type", ""):
            edits.set(e, "defer", "")
        elif e.tag == "img":
            if re.search("spacer|divider|decoration", a.get("src", "")) and a.get("alt", "").strip():
                edits.set(e, "alt", "")
            if n_img >= 2 and not a.get("loading"):
                edits.set(e, "loading", "lazy")
            n_img += 1
        elif e.tag in ("div", "span") and "onclick" in a and not a.get("role") and "tabindex" not in a:
            edits.set(e, "role", "button")
            edits.set(e, "tabindex", "0")
        if e.tag == "a" and a.get("target") == "_blank":
            rel = list(dict.fromkeys(a.get("rel", "").lower().split()))
            if missing := [x for x in ("noopener", "noreferrer") if x not in rel]:
                edits.set(e, "rel", " ".join(rel + missing))
        if e.tag in ("a", "button") and page.text_of(e).strip().lower() in GENERIC:
            words = slug_words(a.get("href", ""))
            if 2 < len(words) < 40:
                edits.add(e.inside, e.end, escaped(re.sub(r"\b[a-z]", lambda m: m[0].upper(), words)))
    place = box.end if box else body.start if (body := page.first("body")) else root.inside if root else 0
    if not charset:
        at = box.inside if box else place
        edits.add(at, at, '<meta charset="utf-8">')
    if head:
        edits.add(place, place, "".join(head))
    return edits


# --- as jobs ----------------------------------------------------------------------------------------


def _per_page(pages: DataFrame, columns: list[str], rows, schema: str) -> DataFrame:
    """``rows(page, *columns)`` of every page; ``schema`` is of what it gives, after page_id."""
    names = ["page_id", *[f.split()[0] for f in schema.split(", ")]]
    out = f"page_id {pages.schema['page_id'].dataType.simpleString()}, {schema}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                lists = [part.column(x).to_pylist() for x in ("page_id", "html", *columns)]
                made = [(pid, *r) for pid, source, *own in zip(*lists, strict=True) for r in rows(Page(source), *own)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in made], t) for k, t in enumerate(kinds)], names)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kinds = to_arrow_schema(_parse_datatype_string(out)).types
    return pages.select("page_id", "html", *columns).mapInArrow(run, out)


def elements(pages: DataFrame) -> DataFrame:
    """``ext_elements`` as rows: node (in the order of opening tags), parent (-1 for none), tag, nth (of its tag among its
    siblings), path, attrs, start and stop in the page. Null and empty pages have none."""
    return _per_page(pages, [], lambda p: [(e.node, e.parent, e.tag, e.nth, p.path(e), list(e.attrs.items()), e.start, e.stop) for e in p.elements], "node int, parent int, tag string, nth int, path string, attrs map<string,string>, start int, stop int")


def sections(pages: DataFrame) -> DataFrame:
    """``ext_sections``: the h2 and h3 of every page with the words that follow them."""
    return _per_page(pages, [], lambda p: [(i, e.tag, e.start, n) for i, (e, n) in enumerate(p.sections())], "section int, tag string, start int, n_words long")


def form_fields(pages: DataFrame) -> DataFrame:
    """``ext_form_fields``: the fields of every page and whether they are labelled."""

    def rows(p: Page) -> list[tuple]:
        named = p.labelled()
        return [(e.start, e.tag, e.attrs.get("type", "").lower(), e.attrs.get("name", ""), e.node in named) for e in p.fields()]

    return _per_page(pages, [], rows, "start int, tag string, type string, name string, labelled boolean")


def annotations(pages: DataFrame) -> DataFrame:
    """``audit_element_annotations``: page_id, rule_id, start and path of the element (null for the page as a whole)."""
    return _per_page(pages, [], lambda p: [(rule, e and e.start, e and p.path(e)) for rule, e in findings(p)], "rule_id string, start int, path string")


def repaired(pages: DataFrame) -> DataFrame:
    """``fix_repaired_pages``: the page with all edits applied, and their number."""

    def rows(p: Page, url: str | None) -> list[tuple]:
        edits = repairs(p, url or "")
        return [(edits.applied(), len(edits.list))]

    return _per_page(pages, ["url"], rows, "html string, n_edits long")
