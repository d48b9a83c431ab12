"""Allow and block rules for URLs, whose decisions reach every alias of a page."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabspark.functions.session import written

from .graph import key_components

Rule = tuple[str, str, str]  # verdict, host, path

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
TAGS = r"(?is)<(?:link|meta)\s[^>]*>"
VALUE = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty for a NULL text or one without it."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def url_key(url: Column, host: Column | None = None, path: Column | None = None) -> Column:
    """One key of fixed width for the spellings of a URL that reach the same page: without scheme and
    fragment, the host in lower case, an empty path as ``/``. NULL where there is no host."""
    host, path = url_host(url) if host is None else host, url_path(url) if path is None else path
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*(\?[^#]*)", 1)
    return F.when(host != "", F.md5(F.concat(host, F.when(path == "", "/").otherwise(path), query)))


def _ruled(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """(rule, verdict) of the longest rule that fits, else NULL; of equally long ones an allowing one, then the first by text."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for kind, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r[1] + r[2]), reverse=True):
        h = h.translate(str.maketrans(_UPPER, _LOWER))
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(kind).alias("verdict"))).otherwise(found)
    return found


def _addresses(rows: DataFrame, url: str, rules: Sequence[Rule], *keep: str) -> DataFrame:
    """(kept columns, host, path, ruled, key) of a column of URLs."""
    parts = rows.select(*keep, url, url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    host, path = F.col("host"), F.col("path")
    return parts.select(*keep, host, path, _ruled(host, path, rules).alias("ruled"), url_key(F.col(url), host, path).alias("key"))


def _attribute(tag: Column, name: str) -> Column:
    value = [F.regexp_extract(tag, rf"(?is)\s{name}{VALUE}", i) for i in (1, 2, 3)]
    return F.trim(F.replace(F.concat(*value), F.lit("&amp;"), F.lit("&")))


def _resolved(base: Column, target: Column) -> Column:
    """A link of a page as a full URL; NULL for none, for a mere fragment and for schemes without a host."""
    scheme = F.substring_index(base, "://", 1)
    site = F.concat(scheme, F.lit("://"), url_host(base))
    path = url_path(base)
    folder = F.regexp_extract(path, r"^(?s)(.*/)", 1)
    return (
        F.when((target == "") | target.startswith("#"), None)
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), None)
        .when(target.startswith("/"), F.concat(site, target))
        .when(target.startswith("?"), F.concat(site, path, target))
        .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), target))
    )


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(from_url, to_url): canonical links and refresh redirects that the pages declare themselves.

    Tags inside comments, scripts and styles do not count. Rows without a host or without html declare
    nothing; so does a link to a fragment, or with a scheme other than ``name://``.
    """
    seen = pages.select(F.col(url).alias("from_url"), F.col(html).alias("html"))
    low = F.lower("html")
    seen = seen.where((url_host(F.col("from_url")) != "") & (low.contains("canonical") | low.contains("refresh")))
    shown = F.regexp_replace("html", HIDDEN, " ")
    tags = seen.select("from_url", F.explode(F.regexp_extract_all(shown, F.lit(TAGS), F.lit(0))).alias("tag"))
    tag = F.col("tag")
    is_link, is_meta = F.lower(F.substring(tag, 2, 4)) == "link", F.lower(F.substring(tag, 2, 4)) == "meta"
    canonical = F.array_contains(F.split(F.lower(_attribute(tag, "rel")), r"\s+"), "canonical")
    refresh = F.lower(_attribute(tag, "http-equiv")) == "refresh"
    after = F.regexp_extract(_attribute(tag, "content"), r"""(?is)^[^;,]*[;,]\s*url\s*=\s*['"]?([^'"]*)""", 1)
    target = F.when(is_link & canonical, _attribute(tag, "href")).when(is_meta & refresh, F.trim(after))
    # Exploding drops NULLs and keeps later filters from repeating these expressions.
    found = tags.select("from_url", F.explode(F.array_compact(F.array(target))).alias("target"))
    full = _resolved(F.col("from_url"), F.col("target"))
    return found.select("from_url", F.explode(F.array_compact(F.array(full))).alias("to_url"))


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    redirects: DataFrame | None = None,
    id: str = "page_id",
    url: str = "url",
    html: str = "html",
) -> DataFrame:
    """(id, host, path, rule, verdict, by_alias) for every row of ``pages``.

    Host: what stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z in lower
    case; path: what follows up to ``?``, ``#`` or the end. Both are empty for a NULL url or one without
    ``://``. A rule (verdict, host, path) fits its host and all subdomains where the path starts with the
    rule's; the longest rule wins, and decides. The rules are held in the plan and tried on every row.

    A URL without a rule of its own is judged by its aliases: all that redirects (``from_url, to_url``, a
    crawl's log), refresh tags and canonical links connect, in either direction and over any number of
    steps, whether or not they are rows of ``pages``. If a rule allows any of them, it is allowed, else
    blocked if a rule blocks any (``by_alias`` is true), else allowed. A URL of its own is its only alias.

    Rows are kept one for one: NULL ids, repeated rows and repeated urls as they are; an empty table gives
    an empty one. Other columns are ignored, whatever their names. DataFrame functions only.
    """
    links = page_links(pages, url, html)
    if redirects is not None:
        links = links.union(redirects.select("from_url", "to_url"))
    ends = links.select("from_url", "to_url").union(links.select("to_url", "from_url")).where("from_url IS NOT NULL")
    ends = _addresses(ends.distinct(), "from_url", rules, "to_url").where("key IS NOT NULL")
    ends = written(ends.select("key", "ruled.verdict", url_key(F.col("to_url")).alias("other")).where("other IS NOT NULL").distinct())
    ruled = ends.where("verdict IS NOT NULL").select("key", "verdict").distinct()
    groups = key_components(ends.select(F.col("key").alias("a"), F.col("other").alias("b")))
    groups = groups.select(F.col("node").alias("key"), "component")
    allowed = F.bool_or(F.col("verdict") == "allow")
    blocked = groups.join(ruled, "key").groupBy("component").agg(allowed.alias("allowed")).where("NOT allowed")
    blocked = written(groups.join(blocked.select("component"), "component").select(F.col("key").alias("blocked_key")))

    asked = pages.select(F.col(id).alias("id"), F.coalesce(F.col(url), F.lit("")).alias("url"))
    judged = _addresses(asked, "url", rules, "id")
    # Rows that need no alias meet nothing, and are spread over all tasks.
    none = F.concat(F.lit("-"), F.xxhash64("id", "host", "path").cast("string"))
    judged = judged.withColumn("key", F.coalesce(F.when(F.col("ruled").isNull(), F.col("key")), none))
    met = judged.join(blocked, F.col("key") == F.col("blocked_key"), "left")
    by_alias = F.col("blocked_key").isNotNull()
    verdict = F.coalesce("ruled.verdict", F.when(by_alias, "block").otherwise("allow"))
    return met.select(F.col("id").alias(id), "host", "path", "ruled.rule", verdict.alias("verdict"), by_alias.alias("by_alias"))
