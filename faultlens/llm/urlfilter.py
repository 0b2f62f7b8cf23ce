"""URL filtering with redirect equivalence.

Rules (host, path prefix, verdict) judge the URLs they fit; the longest fitting rule wins.  The
other URLs take the decision of their aliases: URLs joined by redirects and canonical links form
connected components (computed over the whole edge table), and a component with an explicitly
allowed member is allowed, else one with a blocked member is blocked.  A URL's own rule always
stands, so an explicit allow is never undone by a block that an alias carries.

Two URLs are the same node if host and path agree, the path without ``.`` and ``..`` segments
(scheme, query and fragment are ignored).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import discard, stored
from faultlens.llm.components import connected_components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str       # starts with "/"
    verdict: str    # "allow" or "block"

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules of the registered query.
RULES = (Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"),
         Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block"))


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def _fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def rule_and_verdict(rules: tuple[Rule, ...], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest fitting rule's text and verdict (of equally long ones an allow), else null."""
    text = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.verdict == "allow", r.text)):   # later ones win
        fits = _fits(r, host, path)
        text = F.when(fits, F.lit(r.text)).otherwise(text)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def _plain(path: Column) -> Column:
    """The path without its ``.`` and ``..`` segments."""
    parts = F.split(path, "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == ".", acc)
                       .when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1))))
                       .otherwise(F.array_append(acc, x)))
    last = F.element_at(parts, -1)
    return F.when(path.contains("/."), F.concat(F.array_join(kept, "/"), F.when(last.isin(".", ".."), F.lit("/")).otherwise(F.lit("")))) \
        .otherwise(path)


def _resolved(link: Column, url: Column) -> Column:
    """A page's link as an absolute URL; null if it leads nowhere else (another scheme, or the page itself)."""
    host, path = host_of(url), path_of(url)
    folder = F.regexp_extract(path, r"(?s)^(.*/)", 1)
    return (F.when(link.rlike(r"(?i)^https?://"), link)
            .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
            .when(link.startswith("//"), F.concat(F.lit("x:"), link))
            .when(link.startswith("/"), F.concat(F.lit("x://"), host, link))
            .when(link.rlike("^[?#]") | (link == ""), F.lit(None))
            .otherwise(F.concat(F.lit("x://"), host, F.when(folder == "", F.lit("/")).otherwise(folder), link)))


# What holds no markup: comments, scripts, styles and texts.
_HIDDEN = r"(?is)<!--.*?(?:-->|$)|<(script|style|title|textarea|xmp|template)\b.*?(?:</\1\s*>|$)"
_TAG = r"(?is)<(?:link|meta)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"


def _attribute(tag: Column, name: str) -> Column:
    """Value of a tag's attribute, trimmed, with its ampersands decoded; empty if it has none."""
    raw = F.regexp_extract(tag, rf"(?is)^<\w+(?:[^>\"'=]++=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"']++)|[^>\"'=\s]++(?=[\s>/])|[\s/])*?"
                                r"[\s/\"']" + name + r"\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)", 1)
    value = F.regexp_replace(raw, r"(?s)^[\"'](.*)[\"']$", "$1")
    return F.trim(F.regexp_replace(value, "(?i)&(?:amp|#38|#x26);", "&"))


def page_links(pages: DataFrame) -> DataFrame:
    """(src, dst) URLs of each page's canonical links and meta refreshes; those inside comments, scripts
    and other hidden text do not count, nor do links to the page itself or by other schemes than http and https."""
    shown = pages.where(F.col("html").rlike(r"(?i)canonical|refresh") & F.col("url").contains("://")) \
        .select("url", F.regexp_replace("html", _HIDDEN, " ").alias("shown"))
    tags = shown.select("url", F.explode(F.regexp_extract_all("shown", F.lit(_TAG), F.lit(0))).alias("tag"))
    tag = F.col("tag")
    rel = F.array_contains(F.split(F.lower(_attribute(tag, "rel")), r"\s+"), "canonical")
    refresh = F.lower(_attribute(tag, "http-equiv")) == "refresh"
    target = F.trim(F.regexp_extract(_attribute(tag, "content"), r"(?is)^[\s\d.]*[;,]\s*url\s*=\s*[\"']?([^\"']*)", 1))
    link = F.when(tag.rlike("(?i)^<link") & rel, _attribute(tag, "href")).when(tag.rlike("(?i)^<meta") & refresh, target)
    return tags.select(F.col("url").alias("src"), _resolved(link, F.col("url")).alias("dst")).where("dst is not null")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and component (the smallest host + path among the aliases; null
    if there are none) of every row of ``pages`` (page_id, url, html).

    ``redirects`` (src, dst) adds edges, such as those of a crawl log.  A URL that is null or has no
    ``://`` has an empty host and path, no rule and no aliases, and is allowed.  Repeated rows and
    ids give one row each; other columns are not read; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    edges = page_links(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("src", "dst").where("src is not null and dst is not null"))
    node = lambda c: F.concat(host_of(F.col(c)), _plain(path_of(F.col(c))))
    labels, label_path = connected_components(
        edges.select(node("src").alias("a"), node("dst").alias("b")).where("a <> '' and b <> ''"))
    # A node's host ends at its first slash.
    host, path = F.regexp_extract("node", r"(?s)^([^/]*)(.*)$", 1), F.regexp_extract("node", r"(?s)^([^/]*)(.*)$", 2)
    decided = labels.withColumn("own", rule_and_verdict(rules, host, path)[1])
    fate = decided.groupBy("component").agg(
        F.when(F.max(F.col("own") == "allow"), F.lit("allow"))
        .when(F.max(F.col("own") == "block"), F.lit("block")).otherwise(F.lit("allow")).alias("fate"))
    fate, fate_path = stored(fate, "url_fate")
    by_node, _ = stored(labels.join(fate, "component"), "url_nodes")
    discard(spark, label_path, fate_path)
    judged = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    text, verdict = rule_and_verdict(rules, F.col("host"), F.col("path"))
    judged = judged.withColumn("rule", text).withColumn("own", verdict).withColumn("node", F.concat("host", _plain(F.col("path"))))
    return judged.join(by_node, "node", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("own", "fate", F.lit("allow")).alias("verdict"), "component")


def allowed(pages: DataFrame, **options) -> DataFrame:
    """page_id of the pages that may stay."""
    return judge(pages, **options).where("verdict = 'allow'").select("page_id")


def oracle(rules: tuple[Rule, ...] = RULES, edges: str | None = None) -> str:
    """The same in SQL.  ``edges`` is a query of (src, dst) URLs; the default is that no page has any (the
    given tables hold no canonical links and no refreshes)."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    # The text after the first ://, cut at its first slash, question mark or hash.
    rest = "substr(url, instr(url, '://') + 3)"
    known = "coalesce(instr(url, '://'), 0) > 0"

    def split(c: str, table: str) -> str:
        return f"""SELECT *, CASE WHEN {known} THEN translate(regexp_replace(r, '[/?#].*$', '', 's'), '{_UPPER}', '{_LOWER}') ELSE '' END AS host,
          CASE WHEN {known} THEN regexp_replace(substr(r, length(regexp_replace(r, '[/?#].*$', '', 's')) + 1), '[?#].*$', '', 's') ELSE '' END AS path
          FROM (SELECT *, {rest} AS r FROM (SELECT *, {c} AS url FROM {table}))"""

    def plain(p: str) -> str:
        return (f"(CASE WHEN contains({p}, '/.') THEN list_reduce(string_split({p}, '/'), lambda a, x: CASE x WHEN '.' THEN a "
                f"WHEN '..' THEN regexp_replace(a, '/[^/]*$', '') ELSE a || '/' || x END) || "
                f"CASE WHEN regexp_matches({p}, '/\\.{{1,2}}$') THEN '/' ELSE '' END ELSE {p} END)")

    def case(h: str, p: str, verdict: bool) -> str:
        out = ""
        for r in sorted(rules, key=lambda r: (-len(r.text), r.verdict != "allow", r.text)):
            value = r.verdict if verdict else r.text
            out += (f" WHEN ({h} = {q(r.host)} OR ends_with({h}, {q('.' + r.host)})) AND "
                    f"starts_with({p}, {q(r.path)}) THEN {q(value)}")
        return f"CASE{out} END"

    edges = edges or "SELECT '' AS src, '' AS dst WHERE false"
    return f"""
WITH RECURSIVE edge_urls AS ({edges}),
page AS ({split('page_url', '(SELECT page_id, url AS page_url FROM pages)')}),
a AS (SELECT src, dst, host || {plain('path')} AS node FROM ({split('src', 'edge_urls')})),
b AS (SELECT src, dst, host || {plain('path')} AS node FROM ({split('dst', 'edge_urls')})),
pairs AS (SELECT a.node AS x, b.node AS y FROM a JOIN b ON a.src = b.src AND a.dst = b.dst WHERE a.node <> '' AND b.node <> ''),
both_ways AS (SELECT x, y FROM pairs WHERE x <> y UNION SELECT y, x FROM pairs WHERE x <> y),
reach AS (SELECT x AS node, x AS other FROM both_ways
          UNION SELECT r.node, e.y FROM reach r JOIN both_ways e ON r.other = e.x),
own AS (SELECT node, other, split_part(other, '/', 1) AS h, substr(other, length(split_part(other, '/', 1)) + 1) AS p FROM reach),
fate AS (SELECT node, min(other) AS component,
                CASE WHEN count(*) FILTER (WHERE v = 'allow') > 0 THEN 'allow'
                     WHEN count(*) FILTER (WHERE v = 'block') > 0 THEN 'block' ELSE 'allow' END AS fate
         FROM (SELECT node, other, {case('h', 'p', True)} AS v FROM own) GROUP BY node)
SELECT page_id, host, path, {case('host', 'path', False)} AS rule,
       coalesce({case('host', 'path', True)}, fate, 'allow') AS verdict, component
FROM page LEFT JOIN fate ON host || {plain('path')} = node"""
