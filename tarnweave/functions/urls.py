"""URL columns: canonical form, hashes, resolution, robots rules."""

from __future__ import annotations

from urllib.parse import urldefrag, urljoin

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SKIPPED = ("#", "javascript:", "mailto:", "tel:", "data:")


def part(c: Column, name: str) -> Column:
    """A component, null where the URL can't be parsed."""
    return F.try_parse_url(c, F.lit(name))


def canonical(c: Column) -> Column:
    """Lower-case scheme and host, no fragment or default port, query sorted by key and value, no trailing slashes.

    The case of the path stays. A text that can't be parsed, or without scheme and host, stays as it is.
    """
    scheme, host = F.lower(part(c, "PROTOCOL")), F.lower(part(c, "AUTHORITY"))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    pairs = F.filter(F.split(part(c, "QUERY"), "&"), lambda p: p != "")

    def fields(p: Column) -> Column:
        at = F.instr(p, "=")
        key, value = F.when(at > 0, F.left(p, at - 1)).otherwise(p), F.when(at > 0, F.substr(p, at + 1)).otherwise("")
        return F.struct(F.coalesce(F.try_url_decode(key), key).alias("k"), F.coalesce(F.try_url_decode(value), value).alias("v"))

    query = F.array_join(F.transform(F.array_sort(F.transform(pairs, fields)), lambda e: F.concat(F.url_encode(e["k"]), F.lit("="), F.url_encode(e["v"]))), "&")
    path = F.regexp_replace(F.coalesce(part(c, "PATH"), F.lit("")), "/+$", "")
    path = F.when(path == "", "/").otherwise(path)
    full = F.concat(scheme, F.lit("://"), host, path, F.when(F.coalesce(query, F.lit("")) != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.coalesce(full, c)


def url_hash(c: Column) -> Column:
    """32 hex digits: the first half of the canonical URL's SHA-256."""
    return F.substring(F.sha2(c, 256), 1, 32)


def host(c: Column) -> Column:
    return part(c, "HOST")


def is_web_url(c: Column) -> Column:
    """http or https with a host; false for anything unparsable or null."""
    return F.coalesce(F.lower(part(c, "PROTOCOL")).isin("http", "https") & (F.coalesce(part(c, "HOST"), F.lit("")) != ""), F.lit(False))


def followable(href: Column) -> Column:
    """A reference worth resolving: not empty, a fragment, or of a scheme without pages."""
    bad = href == ""
    for p in SKIPPED:
        bad = bad | href.startswith(p)
    return F.coalesce(~bad, F.lit(False))


@F.arrow_udf(T.StringType())
def _resolve(base: pa.Array, ref: pa.Array) -> pa.Array:
    out = []
    for b, r in zip(base.to_pylist(), ref.to_pylist()):
        try:
            out.append(None if b is None or r is None else urldefrag(urljoin(b, r.strip())).url)
        except ValueError:
            out.append(None)
    return pa.array(out, pa.string())


def resolve(base: Column, ref: Column) -> Column:
    """The absolute URL of a reference, without fragment; null where it can't be parsed.

    Absolute references and absolute paths without dot segments stay in the JVM.
    """
    clean = F.regexp_replace(F.btrim(ref), "#.*$", "")
    origin = F.concat(part(base, "PROTOCOL"), F.lit("://"), part(base, "AUTHORITY"))
    easy_abs = clean.rlike("^https?://[^/?#]+(/[^.]*)?$")
    easy_path = clean.rlike("^/([^/.][^.]*)?$")
    hard = ~(F.coalesce(easy_abs | easy_path, F.lit(True)))
    return F.when(easy_abs, clean).when(easy_path, F.concat(origin, clean)).otherwise(_resolve(F.when(hard, base), F.when(hard, ref)))


def file_name(c: Column) -> Column:
    """Last path segment; for URLs without one, 8 bytes of the URL's SHA-256 in hex."""
    last = F.element_at(F.split(F.coalesce(part(c, "PATH"), F.lit("")), "/"), -1)
    return F.when(F.coalesce(last, F.lit("")).isin("", "."), F.substring(F.sha2(c, 256), 1, 16)).otherwise(last)


# -- robots


def robots_match(pattern: str, path: str) -> bool:
    """Prefix match; each * takes the first place where what follows it occurs; a final $ wants the path's end there."""
    if not pattern:
        return False
    anchored = pattern.endswith("$")
    if anchored:
        pattern = pattern[:-1]
    if "*" not in pattern:
        return path == pattern if anchored else path.startswith(pattern)
    at = 0
    for i, piece in enumerate(pattern.split("*")):
        if not piece:
            continue
        found = path.find(piece, at)
        if found < 0 or (i == 0 and found):
            return False
        at = found + len(piece)
    return at == len(path) if anchored else True


def parse_robots(content: str | None, agent: str) -> tuple[list[str], list[str], float | None, list[str]]:
    """(allow, disallow, crawl delay, sitemaps). The latest User-agent line alone decides whether rules count; sitemaps always do."""
    allow: list[str] = []
    disallow: list[str] = []
    maps: list[str] = []
    delay, ours = None, False
    for raw in (content or "").split("\n"):
        key, colon, value = raw.partition("#")[0].strip().partition(":")
        key, value = key.strip().lower(), value.strip()
        if not colon:
            continue
        if key == "user-agent":
            ours = value == "*" or agent.lower() in value.lower()
        elif key == "sitemap":
            maps.append(value)
        elif ours and key in ("allow", "disallow") and value:
            (allow if key == "allow" else disallow).append(value)
        elif ours and key == "crawl-delay":
            try:
                delay = float(value.split()[0])
            except (ValueError, IndexError):
                pass
    return allow, disallow, delay, maps


def robots_rules(content: Column, agent: str) -> Column:
    """Struct of allow, disallow, crawl_delay, sitemaps."""

    @F.udf("struct<allow:array<string>,disallow:array<string>,crawl_delay:double,sitemaps:array<string>>", useArrow=True)
    def rules(text: str | None) -> tuple:
        return parse_robots(text, agent)

    return rules(content)


def robots_allowed(path: Column, allow: Column, disallow: Column) -> Column:
    """Any matching Allow wins over any Disallow; null rules allow all.

    Patterns without * are matched in the JVM; only rows with a wildcard rule go to Python.
    """

    @F.udf("boolean", useArrow=True)
    def exact(p: str | None, a: list | None, d: list | None) -> bool:
        return any(robots_match(x, p or "") for x in a or ()) or not any(robots_match(x, p or "") for x in d or ())

    def plain(rule: Column) -> Column:
        return F.when(rule.endswith("$"), path == F.regexp_replace(rule, r"\$$", "")).otherwise(F.startswith(path, rule))

    a, d = F.coalesce(allow, F.array().cast("array<string>")), F.coalesce(disallow, F.array().cast("array<string>"))
    wild = F.exists(F.concat(a, d), lambda r: r.contains("*"))

    return F.when(wild, exact(F.when(wild, path), F.when(wild, a), F.when(wild, d))).otherwise(F.exists(a, plain) | ~F.exists(d, plain))
