"""Page operators: each parses a page once, in Arrow batches, and returns rows or one struct of what was asked for.

Filters on other columns belong before these operators: Spark pushes none through them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..functions import extract, text, urls
from ..functions.htmldom import Document, parse
from ..session import spread

Rows = Callable[[str, str, Document], Iterator[tuple] | list[tuple]]


def page_rows(pages: DataFrame, schema: str, fn: Rows, keep: Sequence[str] = (), url: str = "url", html: str = "html", more: Sequence[str] = ()) -> DataFrame:
    """fn(url, html, document) yields tuples of `schema` for each page; `keep` names columns repeated before them, `more` columns that fn gets besides."""
    own: StructType = _parse_datatype_string(schema)
    out = StructType([pages.schema[k] for k in keep] + own.fields)
    arrow, n = to_arrow_schema(out, prefers_large_types=False), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = batch.to_pydict()
            kept, own = [cols[k] for k in keep], [cols[f"_m{k}"] for k in range(len(more))]
            for lo in range(0, batch.num_rows, 256):
                rows = [(*[c[i] for c in kept], *r) for i in range(lo, min(lo + 256, batch.num_rows)) for r in fn(cols["_u"][i] or "", cols["_h"][i] or "", parse(cols["_h"][i]), *[c[i] for c in own])]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), arrow)], schema=arrow)

    return spread(pages.select(*keep, F.col(url).alias("_u"), F.col(html).alias("_h"), *[F.col(c).alias(f"_m{k}") for k, c in enumerate(more)])).mapInArrow(run, out)


FEATURES = "title string, description string, keywords string, canonical string, language string, author string, h1 array<string>, h2 array<string>, h3 array<string>, body string, links int, images int, images_without_alt int, h1_count int, og_title string, og_image string, robots string, viewport string"


def features(pages: DataFrame, keep: Sequence[str] = ("page_id", "url"), noise: str = extract.NOISE) -> DataFrame:
    """What index rows and audits need, from one parse."""

    def one(url: str, raw: str, doc: Document) -> list[tuple]:
        def attr(css: str, name: str) -> str:
            n = doc.first(css)
            return n.attrs.get(name, "") if n else ""

        def meta(name: str, key: str = "name") -> str:
            return attr(f'meta[{key}="{name}"]', "content")

        title = doc.first("title")
        imgs = doc.select("img")
        return [
            (
                title.text().strip() if title else "",
                meta("description"),
                meta("keywords"),
                attr('link[rel="canonical"]', "href"),
                attr("html", "lang"),
                meta("author"),
                extract.texts(doc, "h1"),
                extract.texts(doc, "h2"),
                extract.texts(doc, "h3"),
                extract.body_text(doc, noise),
                len(doc.select("a[href]")),
                len(imgs),
                sum(not i.attrs.get("alt", "").strip() for i in imgs),
                len(doc.select("h1")),
                meta("og:title", "property"),
                meta("og:image", "property"),
                meta("robots"),
                meta("viewport"),
            )
        ]

    return page_rows(pages, FEATURES, one, keep)


def search_index(pages: DataFrame, keep: Sequence[str] = ("page_id", "url"), noise: str = extract.NOISE) -> DataFrame:
    """Index rows: metadata, headings, body text up to 5000 bytes, counts, and a hash of the cut text. Pages with neither a title nor over 10 words are left out."""
    f = features(pages, keep, noise)
    words = F.when(F.col("body") == "", 0).otherwise(F.size(F.split("body", " ")))
    f = f.withColumn("word_count", words).where((F.col("title") != "") | (F.col("word_count") > 10)).withColumn("body_text", text.truncate(F.col("body"), 5000))
    return f.select(*keep, "title", "description", "keywords", "canonical", "language", "h1", "h2", "h3", "body_text", "word_count", F.col("links").alias("outbound_links"), "images", text.content_hash(F.col("body_text")).alias("content_hash"))


def content_rows(pages: DataFrame, keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """For language models: title, description, author, headings under 200 bytes, body up to 3000 bytes; pages with a title or over 200 words."""
    f = features(pages, keep)
    words = F.when(F.col("body") == "", 0).otherwise(F.size(F.split("body", " ")))
    heads = F.filter(F.concat("h1", "h2", "h3"), lambda h: F.octet_length(h) < 200)
    return f.where((F.col("title") != "") | (words > 200)).select(*keep, "title", "description", "author", heads.alias("headings"), text.truncate(F.col("body"), 3000, "").alias("content"))


def seo_issues() -> Column:
    """array<struct<severity,category,message,penalty>> from features()."""

    def issue(when: Column, severity: str, category: str, message: Column | str, penalty: Column | int) -> Column:
        m, p = (F.lit(x) if not isinstance(x, Column) else x for x in (message, penalty))
        return F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(category).alias("category"), m.alias("message"), p.cast("int").alias("penalty")))

    t, d = F.octet_length("title"), F.octet_length("description")
    miss, h1 = F.col("images_without_alt"), F.col("h1_count")
    found = F.array(
        issue(t == 0, "error", "title", "Missing title tag", 20),
        issue(t > 60, "warning", "title", F.format_string("Title too long (%d chars, limit 60)", t), 5),
        issue((t > 0) & (t < 10), "warning", "title", "Title too short", 5),
        issue(d == 0, "error", "description", "Missing meta description", 15),
        issue(d > 160, "warning", "description", F.format_string("Description too long (%d chars, limit 160)", d), 5),
        issue(F.col("canonical") == "", "warning", "canonical", "Missing canonical URL", 5),
        issue(h1 == 0, "error", "headings", "Missing H1 tag", 10),
        issue(h1 > 1, "warning", "headings", F.format_string("Multiple H1 tags (%d)", h1), 5),
        issue(F.col("og_title") == "", "info", "opengraph", "Missing og:title", 3),
        issue(F.col("og_image") == "", "info", "opengraph", "Missing og:image", 3),
        issue(miss > 0, "warning", "images", F.format_string("%d images without alt text", miss), F.least(miss * 2, F.lit(10))),
        issue(F.col("robots").contains("noindex"), "warning", "robots", "Page asks not to be indexed", 0),
        issue(F.col("viewport") == "", "warning", "mobile", "Missing viewport meta tag", 5),
    )
    return F.filter(found, lambda x: x.isNotNull())


def seo_audit(pages: DataFrame, keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """Score out of 100 and the issues that lower it."""
    f = features(pages, keep).withColumn("issues", seo_issues())
    score = F.greatest(F.lit(0), 100 - F.aggregate("issues", F.lit(0), lambda a, x: a + x["penalty"]))
    return f.select(*keep, score.alias("score"), "issues", "title", "description", "canonical", "robots", "viewport", "og_title", "og_image")


def page_links(pages: DataFrame, keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """(position, link): distinct absolute web links of each page."""
    return page_rows(pages, "position int, link string", lambda u, h, d: list(enumerate(extract.links(d, u))), keep)


def link_graph(pages: DataFrame) -> DataFrame:
    """Edges (source, target, anchor, nofollow, external), repeats included."""
    return page_rows(pages.withColumn("source", F.col("url")), "target string, anchor string, nofollow boolean, external boolean", lambda u, h, d: extract.backlinks(d, u), ("source",))


def extract_rules(pages: DataFrame, rules: Sequence[extract.Rule], keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """fields map<string,array<string>> by the rules; pages where nothing matches are left out."""
    rules = tuple(rules)

    def one(url: str, raw: str, doc: Document) -> list[tuple]:
        got = extract.apply_rules(raw, doc, rules)
        return [(got,)] if got else []

    return page_rows(pages, "fields map<string,array<string>>", one, keep)


def structured_data(pages: DataFrame, keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """(kind, data, raw) per block of structured data; data is JSON."""
    return page_rows(pages, "kind string, data string, raw string", lambda u, h, d: [(k, json.dumps(x, ensure_ascii=False, sort_keys=True), r) for k, x, r in extract.structured(d)], keep)


def composite(pages: DataFrame, rules: Sequence[extract.Rule], keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """One item per page, as JSON: rule fields (one value as a scalar, several as an array) and structured data, which wins over rules of the same name; plus the page's links."""
    rules = tuple(rules)

    def one(url: str, raw: str, doc: Document) -> list[tuple]:
        item: dict[str, object] = {k: v[0] if len(v) == 1 else v for k, v in extract.apply_rules(raw, doc, rules).items()}
        item |= extract.structured_fields(extract.structured(doc))
        return [(json.dumps(item, ensure_ascii=False, sort_keys=True), extract.links(doc, url))]

    return page_rows(pages, "item string, links array<string>", one, keep)


PAGE = "title string, description string, type string, data array<map<string,string>>, meta map<string,string>, links array<struct<text:string,url:string,rel:string>>, images array<struct<url:string,alt:string>>, tables array<struct<headers:array<string>,rows:array<map<string,string>>>>, json_ld array<string>"


def auto_extract(pages: DataFrame, keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """One nested row per page; values of data that aren't strings are JSON."""

    def flat(d: dict) -> dict[str, str]:
        return {k: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, sort_keys=True) for k, v in d.items()}

    def one(url: str, raw: str, doc: Document) -> list[tuple]:
        p = extract.auto_extract(url, doc)
        return [
            (
                p.title,
                p.description,
                p.type,
                [flat(d) for d in p.data],
                p.meta,
                [dict(zip(("text", "url", "rel"), x)) for x in p.links],
                [dict(zip(("url", "alt"), x)) for x in p.images],
                [{"headers": h, "rows": r} for h, r in p.tables],
                [json.dumps(d, ensure_ascii=False, sort_keys=True) for d in p.json_ld],
            )
        ]

    return page_rows(pages, PAGE, one, keep)


def dom_nodes(pages: DataFrame, keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """The tree as rows: node, parent, place among siblings, depth, tag, attributes, own text. Traversals are joins and windows over it."""

    def one(url: str, raw: str, doc: Document) -> Iterator[tuple]:
        depth: dict[int, int] = {}
        for n in doc.nodes:
            up = n.parent.pos if n.parent is not None else -1
            depth[n.pos] = depth.get(up, -1) + 1
            yield n.pos, up if up >= 0 else None, n.index, depth[n.pos], n.tag, dict(n.attrs), n.own_text()

    return page_rows(pages, "node int, parent int, place int, depth int, tag string, attrs map<string,string>, own_text string", one, keep)


def selector_candidates(pages: DataFrame, wanted: Column, most: int = 10) -> DataFrame:
    """(selector, score, specificity, matches) for elements that contain the text `wanted` of each page."""

    def one(url: str, raw: str, doc: Document, text_: str | None) -> list[tuple]:
        return [(k, *c) for k, c in enumerate(extract.selectors_for_text(doc, text_, most))] if text_ else []

    return page_rows(pages.withColumn("_wanted", wanted), "rank int, selector string, score double, specificity int, matches int", one, ("page_id",), more=("_wanted",))


def similar_elements(pages: DataFrame, css: str, most: int = 10) -> DataFrame:
    return page_rows(pages, "rank int, path string, text string, similarity double", lambda u, h, d: [(k, *x) for k, x in enumerate(extract.similar_elements(d, css, most))], ("page_id",))


def relocate(old: DataFrame, new: DataFrame, css: str, on: str | Sequence[str] = "url") -> DataFrame:
    """(strategy, selector) by which each page's element of the old version is found in the new one; null where it isn't.

    `on` names the key of a page, repeated before them (a single one as url). Versions of several pages under one key all meet each other.
    """
    keys = ["url"] if isinstance(on, str) else list(on)
    old, new = (df.withColumn("url", F.col(on)) if isinstance(on, str) else df for df in (old, new))
    both = old.select(*keys, F.col("html").alias("was")).join(new.select(*keys, "html"), keys).withColumn("_url", F.col(keys[0]).cast("string"))

    def one(url: str, raw: str, doc: Document, was: str | None) -> list[tuple]:
        snap = extract.snapshot(parse(was), css)
        got = extract.relocate(doc, snap) if snap else None
        return [got or (None, None)]

    return page_rows(both, "strategy string, selector string", one, keys, url="_url", more=("was",))


# -- classifiers over responses: native expressions

CAPTCHA_MARKERS = tuple("g-recaptcha h-captcha cf-turnstile captcha recaptcha/api hcaptcha.com challenges.cloudflare.com".split())
CHALLENGE_MARKERS = tuple("cloudflare cf-browser-verification jschl-answer cf_chl_opt challenge-platform".split())


def captcha_marker(body: Column) -> Column:
    """The first marker of the list that the lower-case body contains."""
    low = F.lower(body)
    return F.coalesce(*[F.when(low.contains(m), m) for m in CAPTCHA_MARKERS])


def captcha_kind(body: Column) -> Column:
    """struct<kind,site_key>; null without a site key."""
    low, key = F.lower(body), text.between(body, 'data-sitekey="', '"')
    kind = (
        F.when(low.contains("recaptcha") & low.contains("recaptcha/api.js?render="), "recaptcha_v3")
        .when(low.contains("recaptcha"), "recaptcha_v2")
        .when(low.contains("hcaptcha") | body.contains("h-captcha"), "hcaptcha")
        .when(low.contains("turnstile"), "turnstile")
    )
    return F.when((key != "") & kind.isNotNull(), F.struct(kind.alias("kind"), key.alias("site_key")))


def _contains_any(body: Column, markers: Sequence[str]) -> Column:
    low, out = F.lower(body), F.lit(False)
    for m in markers:
        out = out | low.contains(m)
    return F.coalesce(out, F.lit(False))


def _edge_header(headers: Column) -> Column:
    return F.coalesce((F.element_at(headers, "Cf-Ray") != "") | (F.element_at(headers, "Server") == "cloudflare"), F.element_at(headers, "Server") == "cloudflare", F.lit(False))


def is_challenge(status: Column, headers: Column, body: Column, strict: bool = False) -> Column:
    """403 or 503 with a marker in the body or an edge header; strict: with both."""
    body_has = _contains_any(body, CHALLENGE_MARKERS if strict else (*CHALLENGE_MARKERS, "_cf_chl_tk", "ray id"))
    return status.isin(403, 503) & ((body_has & _edge_header(headers)) if strict else (body_has | _edge_header(headers)))


def is_rate_limited(status: Column, headers: Column) -> Column:
    left, again = F.element_at(headers, "X-RateLimit-Remaining"), F.element_at(headers, "Retry-After")
    return (status == 429) | ((status == 403) & (F.coalesce(left == "0", F.lit(False)) | (F.coalesce(again, F.lit("")) != "")))


def is_retryable(error: Column) -> Column:
    """Over error classes: never cancellation or a deadline; an end of file, a timeout, a reset or refused connection are."""
    return F.coalesce(error.isin("eof", "unexpected_eof", "timeout", "connection_reset", "connection_refused"), F.lit(False))


def origin_path(url: Column) -> Column:
    return F.coalesce(urls.part(url, "PATH"), F.lit("/"))
