"""Extraction from parsed pages: rules, structured data, automatic detection, selectors, relocation. No Spark here."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from urllib.parse import urldefrag, urljoin, urlsplit

from .htmldom import Document, Node, xpath
from .normalize import PRICE

META_NAMES = tuple("description keywords author robots viewport generator theme-color application-name msapplication-TileColor".split())
NOISE = ", ".join("script style nav footer header aside .sidebar .menu .nav .cookie".split())
PRODUCTS = tuple("[itemtype*='Product'] .product .product-card .product-item .product-grid-item [data-product] .item-card".split())
ARTICLES = tuple("article [itemtype*='Article'] [itemtype*='NewsArticle'] [itemtype*='BlogPosting'] .post .article .blog-post .entry-content".split())
STABLE_ATTRS = tuple("data-testid data-id data-name data-type role aria-label name".split())
_PRICE = re.compile(PRICE)
_ESCAPED = re.compile(r"([:.\[\]()/ ])")


@dataclass(frozen=True)
class Rule:
    """One field: a css or xpath selector with what to take (text, html, outer_html or an attribute), or a regex on the raw page."""

    name: str
    selector: str = ""
    type: str = "css"
    attribute: str = ""
    pattern: str = ""


def clip(s: str, limit: int, suffix: str = "...") -> str:
    """At most `limit` bytes, whole characters, then the suffix."""
    b = s.encode()
    return s if len(b) <= limit else b[:limit].decode("utf-8", "ignore") + suffix


def size(s: str) -> int:
    return len(s.encode())


def value_of(n: Node, attribute: str) -> str:
    if attribute in ("", "text"):
        return n.text().strip()
    if attribute in ("html", "inner_html", "innerHTML"):
        return n.inner_html().strip()
    if attribute in ("outer_html", "outerHTML"):
        return n.outer_html()
    return n.attrs.get(attribute, "")


@lru_cache(1024)
def _regex(pattern: str) -> re.Pattern:
    return re.compile(pattern.replace("(?<", "(?P<") if re.search(r"\(\?<[A-Za-z]", pattern) else pattern)


def regex_values(raw: str, pattern: str) -> list[str]:
    """All matches: the named groups that aren't empty, else group 1, else the whole match."""
    rx, out = _regex(pattern), []
    for m in rx.finditer(raw):
        if rx.groupindex:
            out += [v for v in (m[i] for i in sorted(rx.groupindex.values())) if v]
        else:
            out.append(m[1] or "" if rx.groups else m[0])
    return [v for v in out if v]


def apply_rules(raw: str, doc: Document, rules: Sequence[Rule]) -> dict[str, list[str]]:
    """Field -> values that aren't empty. Later kinds win over earlier ones for the same name: css, regex, xpath. A bad rule gives nothing."""
    out: dict[str, list[str]] = {}
    for kind in ("css", "regex", "xpath"):
        for r in rules:
            if r.type != kind:
                continue
            try:
                if kind == "css":
                    got = [value_of(n, r.attribute) for n in doc.select(r.selector)]
                elif kind == "regex":
                    got = regex_values(raw, r.pattern or r.selector)
                else:
                    got = [n if isinstance(n, str) else value_of(n, r.attribute) for n in xpath(doc, r.selector)]
            except (ValueError, re.error):
                continue
            got = [v for v in got if v]
            if got:
                out[r.name] = got
    return out


def links(doc: Document, base: str) -> list[str]:
    """Distinct absolute web links in order of appearance, without fragments."""
    seen: dict[str, None] = {}
    for a in doc.select("a[href]"):
        href = a.attrs["href"].strip()
        if not a.attrs["href"] or href.startswith(("#", "javascript:", "mailto:", "tel:", "data:")):
            continue
        try:
            full = urldefrag(urljoin(base, href)).url
        except ValueError:
            continue
        if full.startswith(("http://", "https://")):
            seen.setdefault(full)
    return list(seen)


def backlinks(doc: Document, source: str) -> list[tuple[str, str, bool, bool]]:
    """(target, anchor text, nofollow, external) for every reference but fragments and scripts; repeats stay."""
    out = []
    here = urlsplit(source).netloc.rpartition("@")[2]
    for a in doc.select("a[href]"):
        href = a.attrs["href"]
        if not href or href.startswith(("#", "javascript:")):
            continue
        try:
            full = urljoin(source, href)
            there = urlsplit(full).netloc.rpartition("@")[2]
        except ValueError:
            continue
        out.append((full, a.text().strip(), "nofollow" in a.attrs.get("rel", ""), there != here))
    return out


def json_ld(doc: Document, strict: bool = True) -> list[tuple[dict, str]]:
    """(object, raw text) of each block; arrays give their objects (strict: only if all entries are objects). Invalid blocks are skipped."""
    out = []
    for n in doc.select('script[type="application/ld+json"]'):
        raw = n.text().strip()
        try:
            data = json.loads(raw) if raw else None
        except ValueError:
            continue
        if isinstance(data, dict):
            out.append((data, raw))
        elif isinstance(data, list) and (not strict or all(isinstance(d, dict) for d in data)):
            out += [(d, raw) for d in data if isinstance(d, dict)]
    return out


def _prefixed(doc: Document, css: str, names: Sequence[str], prefix: str, keep_empty: bool = False) -> dict[str, str]:
    out = {}
    for n in doc.select(css):
        key = next((n.attrs[a] for a in names if n.attrs.get(a)), "")
        content = n.attrs.get("content", "")
        if key and (content or keep_empty):
            out[key.removeprefix(prefix)] = content
    return out


def microdata(doc: Document) -> list[dict[str, str]]:
    """Properties of each outermost item; a property's value is its href, src, content, datetime or text."""
    out = []
    for n in doc.select("[itemscope]"):
        if any("itemscope" in up.attrs for up in n.ancestors()):
            continue
        data = {"@type": n.attrs["itemtype"]} if n.attrs.get("itemtype") else {}
        for p in doc.select("[itemprop]", n):
            v = next((p.attrs[a] for a in ("href", "src", "content", "datetime") if a in p.attrs), None)
            v = p.text().strip() if v is None else v
            if p.attrs["itemprop"] and v:
                data[p.attrs["itemprop"]] = v
        if data:
            out.append(data)
    return out


def _attr(doc: Document, css: str, name: str) -> str:
    n = doc.first(css)
    return n.attrs.get(name, "") if n else ""


def meta_tags(doc: Document) -> dict[str, object]:
    title = doc.first("title")
    out: dict[str, object] = {}
    if title and title.text().strip():
        out["title"] = title.text().strip()
    for name in META_NAMES:
        if v := _attr(doc, f'meta[name="{name}"]', "content"):
            out[name] = v
    for key, css in (("canonical", 'link[rel="canonical"]'), ("favicon", 'link[rel="shortcut icon"], link[rel="icon"]')):
        if v := _attr(doc, css, "href"):
            out[key] = v
    langs = [{"lang": n.attrs["hreflang"], "href": n.attrs["href"]} for n in doc.select('link[rel="alternate"][hreflang]') if n.attrs.get("hreflang") and n.attrs.get("href")]
    if langs:
        out["hreflang"] = langs
    return out


def structured(doc: Document) -> list[tuple[str, dict, str]]:
    """(kind, data, raw): json-ld, opengraph, twitter-card, microdata, meta; kinds without data are absent."""
    out: list[tuple[str, dict, str]] = [("json-ld", d, raw) for d, raw in json_ld(doc)]
    if og := _prefixed(doc, 'meta[property^="og:"]', ("property",), "og:"):
        out.append(("opengraph", og, ""))
    if tw := _prefixed(doc, 'meta[property^="twitter:"], meta[name^="twitter:"]', ("name", "property"), "twitter:"):
        out.append(("twitter-card", tw, ""))
    out += [("microdata", d, "") for d in microdata(doc)]
    if m := meta_tags(doc):
        out.append(("meta", m, ""))
    return out


def structured_fields(found: Sequence[tuple[str, dict, str]]) -> dict[str, object]:
    """As item fields: the last block of a kind holds, meta tags are prefixed."""
    out: dict[str, object] = {}
    for kind, data, _ in found:
        if kind == "meta":
            out |= {f"meta_{k}": v for k, v in data.items()}
        else:
            out[{"json-ld": "json_ld", "twitter-card": "twitter_card"}.get(kind, kind)] = data
    return out


def tables(doc: Document) -> list[tuple[list[str], list[dict[str, str]]]]:
    """(headers, rows) of each table that has both. Without a thead the first row counts as the header."""
    out = []
    for t in doc.select("table"):
        heads = [n.text().strip() for n in doc.select("tr:first-child th, thead th, thead td", t)]
        if not heads:
            heads = [x for x in (n.text().strip() for n in doc.select("tr:first-child td", t)) if x]
        if not heads:
            continue
        skip = 0 if doc.first("thead", t) else 1
        rows = []
        for tr in doc.select("tr", t)[skip:]:
            row = {heads[k]: td.text().strip() for k, td in enumerate(doc.select("td", tr)) if k < len(heads)}
            if row:
                rows.append(row)
        if rows:
            out.append((heads, rows))
    return out


def table_cells(doc: Document, css: str = "table") -> list[list[str]]:
    """Cells of the first matching table, th and td alike."""
    t = doc.first(css)
    return [[c.text().strip() for c in doc.select("td, th", tr)] for tr in doc.select("tr", t)] if t else []


def list_items(doc: Document, css: str = "ul, ol") -> list[str]:
    n = doc.first(css)
    return [x.text().strip() for x in doc.select("li", n)] if n else []


def _first_text(doc: Document, within: Node, choices: Sequence[str], ok=bool) -> str:
    for css in choices:
        n = doc.first(css, within)
        v = n.text().strip() if n else ""
        if v and ok(v):
            return v
    return ""


def products(doc: Document) -> list[dict[str, str]]:
    """One per container and matching container selector."""
    out = []
    for css in PRODUCTS:
        for s in doc.select(css):
            p: dict[str, str] = {}
            if v := _first_text(doc, s, "h1 h2 h3 .product-title .product-name [itemprop='name'] .title a".split(), lambda x: size(x) < 200):
                p["name"] = v
            price = _first_text(doc, s, ".price [itemprop='price'] .product-price .cost .amount".split())
            if not price and (m := _PRICE.search(s.text())):
                price = m[0]
            if price:
                p["price"] = price
            if img := doc.first("img", s):
                p |= {k: img.attrs[a] for k, a in (("image", "src"), ("image_alt", "alt")) if a in img.attrs}
            if (a := doc.first("a", s)) and "href" in a.attrs:
                p["url"] = a.attrs["href"]
            if v := _first_text(doc, s, ".rating [itemprop='ratingValue'] .stars .review-score".split()):
                p["rating"] = v
            if v := _first_text(doc, s, ".description [itemprop='description'] .product-desc p".split(), lambda x: 10 < size(x) < 1000):
                p["description"] = v
            if p:
                out.append({"_type": "product"} | p)
    return out


def articles(doc: Document) -> list[dict[str, str]]:
    out = []
    for css in ARTICLES:
        for s in doc.select(css):
            a: dict[str, str] = {}
            if v := _first_text(doc, s, ("h1, h2, .title, .headline",)):
                a["title"] = v
            if v := _first_text(doc, s, ".author [itemprop='author'] [rel='author'] .byline".split()):
                a["author"] = v
            for d in "time [itemprop='datePublished'] .date .published .post-date".split():
                if n := doc.first(d, s):
                    if v := n.attrs.get("datetime") if "datetime" in n.attrs else n.text().strip():
                        a["date"] = v
                    if "datetime" in n.attrs or v:
                        break
            if (v := _first_text(doc, s, ("p",))) and size(v) > 20:
                a["content_preview"] = clip(v, 500)
            if a:
                out.append({"_type": "article"} | a)
    return out


@dataclass
class Page:
    """What auto_extract() finds."""

    url: str
    title: str = ""
    description: str = ""
    type: str = "generic"
    data: list[dict] = field(default_factory=list)
    meta: dict[str, str] = field(default_factory=dict)
    links: list[tuple[str, str, str]] = field(default_factory=list)
    images: list[tuple[str, str]] = field(default_factory=list)
    tables: list[tuple[list[str], list[dict[str, str]]]] = field(default_factory=list)
    json_ld: list[dict] = field(default_factory=list)


def auto_extract(url: str, doc: Document) -> Page:
    """Everything recognisable on a page and its type: listing (3 products or more), product, article, data (tables), generic."""
    p = Page(url, title="".join(n.text() for n in doc.select("title")).strip())
    for n in doc.select("meta"):
        if n.attrs.get("name") and n.attrs.get("content"):
            p.meta[n.attrs["name"]] = n.attrs["content"]
    p.description = p.meta.get("description", "")
    p.json_ld = [d for d, _ in json_ld(doc, strict=False)]
    p.data += p.json_ld
    social = _prefixed(doc, 'meta[property^="og:"]', ("property",), "og:", True) | {f"twitter_{k}": v for k, v in _prefixed(doc, 'meta[name^="twitter:"]', ("name",), "twitter:", True).items()}
    if social:
        p.data.append(social)
    p.tables = tables(doc)
    p.data += products(doc)
    p.data += articles(doc)
    p.links = [(n.text().strip(), n.attrs["href"], n.attrs.get("rel", "")) for n in doc.select("a[href]") if n.attrs["href"] not in ("", "#") and not n.attrs["href"].startswith("javascript:")]
    p.images = [(n.attrs["src"], n.attrs.get("alt", "")) for n in doc.select("img[src]") if n.attrs["src"]]
    votes = [d.get("_type") for d in p.data] + [{"Product": "product", "Article": "article", "NewsArticle": "article", "BlogPosting": "article"}.get(str(d.get("@type"))) for d in p.data]
    n = votes.count("product")
    p.type = "listing" if n >= 3 else "product" if n else "article" if "article" in votes else "data" if p.tables else "generic"
    return p


def body_text(doc: Document, noise: str = NOISE) -> str:
    """Text of the body without noise elements, white space squeezed."""
    bodies = doc.select("body")
    if not bodies:
        return ""
    drop = {id(n) for n in doc.select(noise, bodies[0])}
    out, stack = [], list(reversed(bodies[0].kids))
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
        elif id(n) not in drop:
            stack.extend(reversed(n.kids))
    return " ".join("".join(out).split())


def texts(doc: Document, css: str) -> list[str]:
    return [t for t in (n.text().strip() for n in doc.select(css)) if t]


# -- selectors and relocation


def css_escape(s: str) -> str:
    return _ESCAPED.sub(r"\\\1", s)


def path_of(n: Node, depth: int = 3) -> str:
    """Selector from at most `depth` levels; it begins at an id where there is one."""
    parts: list[str] = []
    cur: Node | None = n
    for _ in range(depth):
        if cur is None or cur.tag in ("#doc", "html", "body"):
            break
        if cur.attrs.get("id"):
            parts.insert(0, "#" + css_escape(cur.attrs["id"]))
            break
        parts.insert(0, cur.tag + (f".{css_escape(cur.classes()[0])}" if cur.classes() else ""))
        cur = cur.parent
    return " > ".join(parts)


def selectors_for(n: Node) -> list[tuple[str, int]]:
    """(selector, specificity) by id, classes, telling attributes, path and position."""
    out = []
    if n.attrs.get("id"):
        out.append(("#" + css_escape(n.attrs["id"]), 100))
    names = n.classes()
    out += [(f"{n.tag}.{css_escape(c)}", 20) for c in names]
    if len(names) > 1:
        out.append((n.tag + "".join(f".{css_escape(c)}" for c in names), 10 + 10 * len(names)))
    out += [(f'{n.tag}[{a}="{n.attrs[a]}"]', 50) for a in STABLE_ATTRS if n.attrs.get(a)]
    if p := path_of(n):
        out.append((p, 30))
    if n.parent is not None and n.parent.tag not in ("#doc", "html", "body"):
        out.append((f"{n.parent.tag} > {n.tag}:nth-child({n.index + 1})", 25))
    return out


def _count(doc: Document, css: str) -> int:
    try:
        return len(doc.select(css))
    except ValueError:
        return 0


def selectors_for_text(doc: Document, text: str, most: int = 10) -> list[tuple[str, float, int, int]]:
    """(selector, score, specificity, matches) of elements with at most 5 children that contain the text, best first."""
    out = []
    for n in doc.nodes:
        own = n.text().strip()
        if not own or text not in own or len(n.children()) > 5:
            continue
        for css, spec in selectors_for(n):
            k = _count(doc, css)
            out.append((css, 1.0 if k == 1 else 0.8 if k <= 3 else 0.5 if k <= 10 else 0.2, spec, k))
    return sorted(out, key=lambda c: (-c[1], -c[2]))[:most]


def selectors_for_element(doc: Document, css: str) -> list[tuple[str, float, int, int]]:
    n = doc.first(css)
    out = []
    for s, spec in selectors_for(n) if n else ():
        k = _count(doc, s)
        out.append((s, 1.0 if k == 1 else 0.8 if k <= 3 else 1 / k, spec, k))
    return sorted(out, key=lambda c: (-c[1], -c[2]))


def text_similarity(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    x, y = set(a.lower().split()), set(b.lower().split())
    return len(x & y) / len(x | y) if x | y else 0.0


def list_overlap(a: Sequence[str], b: Sequence[str]) -> float:
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    common = sum(x in set(a) for x in b)
    return common / (len(a) + len(b) - common)


def map_overlap(a: dict, b: dict) -> float:
    return sum(b.get(k) == v for k, v in a.items() if k in b) / max(len(a), len(b)) if a or b else 1.0


def similarity(ref: Node, n: Node) -> float:
    """Classes 0.3, text 0.3, attributes 0.2. The structure's 0.2 is never earned: the reference element counts as childless."""
    if n.tag != ref.tag:
        return 0.0
    return 0.3 * list_overlap(ref.classes(), n.classes()) + 0.3 * text_similarity(ref.text().strip(), n.text().strip()) + 0.2 * map_overlap(ref.attrs, n.attrs)


def similar_elements(doc: Document, css: str, most: int = 10, floor: float = 0.3) -> list[tuple[str, str, float]]:
    """(path, text, similarity) of other elements of the tag, best first."""
    ref = doc.first(css)
    if ref is None:
        return []
    got = [(path_of(n), clip(n.text().strip(), 97) if size(n.text().strip()) > 100 else n.text().strip(), similarity(ref, n)) for n in doc.by_tag[ref.tag] if n is not ref]
    return sorted((g for g in got if g[2] > floor), key=lambda g: -g[2])[:most]


def snapshot(doc: Document, css: str) -> dict | None:
    """What relocate() needs to find an element again."""
    n = doc.first(css)
    if n is None:
        return None
    return {"selector": css, "tag": n.tag, "id": n.attrs.get("id", ""), "classes": n.classes(), "text": n.text().strip(), "attrs": dict(n.attrs), "path": path_of(n, 5)}


def relocate(doc: Document, snap: dict) -> tuple[str, str] | None:
    """(strategy, selector) of the first strategy that finds exactly one element: selector, id, data attributes, classes, path, then the most similar text above 0.7."""
    tries = [("selector", snap["selector"])]
    if snap["id"]:
        tries.append(("id", "#" + css_escape(snap["id"])))
    tries += [("attribute", f'{snap["tag"]}[{k}="{v}"]') for k, v in sorted(snap["attrs"].items()) if k.startswith("data-") or k in ("name", "aria-label")]
    if snap["classes"]:
        tries.append(("classes", snap["tag"] + "".join(f".{css_escape(c)}" for c in snap["classes"])))
    if snap["path"]:
        tries.append(("path", snap["path"]))
    for how, css in tries:
        if _count(doc, css) == 1:
            return how, css
    best, at = 0.0, None
    for n in doc.by_tag.get(snap["tag"], ()) if snap["text"] else ():
        s = text_similarity(snap["text"], n.text().strip())
        if s > best:
            best, at = s, n
    return ("text", path_of(at)) if best > 0.7 else None


# -- traversal


def traverse(n: Node, how: str, nth: int = 1, css: str = "") -> list[Node]:
    """parent (nth up), children, siblings, next, prev, next_all, prev_all, closest (css)."""
    own = n.parent.children() if n.parent is not None else [n]
    if how == "parent":
        up = list(n.ancestors())
        return up[nth - 1 : nth]
    if how == "children":
        return n.children()
    if how == "closest":
        doc_ids = {id(m) for m in _document_of(n).select(css)}
        return next(([m] for m in [n, *n.ancestors()] if id(m) in doc_ids), [])
    return {"siblings": [m for m in own if m is not n], "next": own[n.index + 1 : n.index + 2], "prev": own[max(0, n.index - 1) : n.index], "next_all": own[n.index + 1 :], "prev_all": own[: n.index][::-1]}[how]


def _document_of(n: Node) -> Document:
    while n.parent is not None:
        n = n.parent
    doc = Document()
    doc.root = n
    doc.index()
    return doc


def balanced_json(text: str) -> str:
    """The first {...} with balanced braces (quotes aren't looked at), else {}."""
    start = text.find("{")
    depth = 0
    for i in range(start, len(text)) if start >= 0 else ():
        depth += {"{": 1, "}": -1}.get(text[i], 0)
        if depth == 0:
            return text[start : i + 1]
    return "{}"


