"""URL filter: host and path rules, spread over pages that redirect or point to one another.

Redirects and canonical links (``<link rel=canonical>``, ``<meta
http-equiv=refresh>`` and any redirect pairs given) are edges between URLs.
Distributed connected components over these edges make classes of aliases; a
page without a rule of its own takes the decision of its class, where an
explicit allow of any alias beats every block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattflow.llm.common import SPREAD, ascii_lower, attach, connected_components, whole_text

# (host, path, verdict); a driver-side parameter list that becomes one CASE expression.
Rules = list[tuple[str, str, str]]

_TAGS = r"(?is)<(?:link|meta|base)\s[^>]*>"
_HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script>"
_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)"


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, _SPLIT, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit(""))


def _plain_path(path: Column) -> Column:
    """Without "." and ".." segments; an empty path is "/"."""
    steps = F.split(path, "/")
    none = F.array().cast("array<string>")
    walked = F.aggregate(steps, none, lambda done, s: F.when(s == ".", done).when(
        s == "..", F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done)).otherwise(F.array_append(done, s)))
    last = F.element_at(steps, -1)
    ended = F.when(last.isin(".", ".."), F.array_append(walked, F.lit(""))).otherwise(walked)
    plain = F.when(path.contains("/."), F.array_join(ended, "/")).otherwise(path)
    return F.when(plain == "", F.lit("/")).otherwise(plain)


def alias_key(url: Column) -> Column:
    """What identifies a URL as a node: host, plain path and query; null without ``://``."""
    return F.when(F.instr(url, "://") > 0, F.concat(
        F.lit("://"), host_of(url), _plain_path(path_of(url)), F.regexp_extract(url, _SPLIT, 3)))


def resolve(base: Column, to: Column) -> Column:
    """The address that a reference on a page of address ``base`` names.

    Of a reference without a scheme the scheme is the base's, of one without a
    host the host, of one without a path (a query or a fragment alone) the path
    too; other paths are taken from the base's folder.
    """
    scheme = F.substring_index(base, "://", 1)
    authority = F.concat(scheme, F.lit("://"), F.regexp_extract(base, _SPLIT, 1))
    path, query = path_of(base), F.regexp_extract(base, _SPLIT, 3)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, r"[^/]*$", ""))
    return (F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), to)
            .when(to.startswith("//"), F.concat(scheme, F.lit(":"), to))
            .when(to.startswith("/"), F.concat(authority, to))
            .when(to.startswith("?"), F.concat(authority, path, to))
            .when((to == "") | to.startswith("#"), F.concat(authority, path, query))
            .otherwise(F.concat(authority, folder, to)))


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value without its quotes; null if the tag has none."""
    pattern = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    value = F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])
    return F.when(tag.rlike(pattern), F.trim(F.replace(value, F.lit("&amp;"), F.lit("&"))))


def rule_match(host: Column, path: Column, rules: Rules, what: str) -> Column:
    """The ``name`` or ``verdict`` of the longest rule that fits, else null.

    A rule fits its host and all subdomains when the path starts with the
    rule's; of equally long rules an allow goes first.
    """
    out = F.lit(None).cast("string")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r[2] == "allow")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.lit(h + p if what == "name" else verdict)).otherwise(out)
    return out


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): alias keys of a page and of every address its HTML redirects or points to.

    All ``<link>`` whose ``rel`` lists canonical and all refresh ``<meta>``
    count.  Comments and scripts are skipped, ``&amp;`` is undone, references
    are resolved against the page's first ``<base href>`` or its own address,
    and those of other kinds (mailto and the like) are left out.  The HTML is
    only parsed where one of the tags may be.
    """
    tag, u = F.col("tag"), F.col("u")
    tags = (pages.select(F.col(url).alias("u"), F.col(html).alias("h"))
            .filter(F.col("h").rlike(r"(?i)canonical|http-equiv") & (F.instr(u, "://") > 0))
            .select("u", F.regexp_extract_all(F.regexp_replace("h", _HIDDEN, ""), F.lit(_TAGS), F.lit(0)).alias("tags")))
    named = F.filter("tags", lambda t: t.rlike("(?i)^<base") & _attribute(t, "href").isNotNull())
    based = tags.withColumn("base", F.coalesce(resolve(u, _attribute(F.get(named, 0), "href")), u))
    canonical = tag.rlike("(?i)^<link") & F.array_contains(F.split(F.lower(_attribute(tag, "rel")), r"\s+"), "canonical")
    refresh = tag.rlike("(?i)^<meta") & (F.lower(_attribute(tag, "http-equiv")) == "refresh")
    where = F.regexp_extract(_attribute(tag, "content"), r"""(?is)^[^;,]*[;,]\s*url\s*=\s*["']?([^"']*)""", 1)
    to = F.when(canonical, _attribute(tag, "href")).when(refresh & (where != ""), F.trim(where))
    return (based.select("u", "base", F.explode("tags").alias("tag")).withColumn("to", to).filter(F.col("to").isNotNull())
            .select(alias_key(u).alias("a"), alias_key(resolve(F.col("base"), F.col("to"))).alias("b"))
            .filter(F.col("b").isNotNull()))


def judge(pages: DataFrame, rules: Rules, page_id: str = "page_id", url: str = "url",
          html: str = "html", redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``.

    ``redirects`` may add (from_url, to_url) pairs.  Verdict: the page's own
    rule; else allow if a rule allows any alias, block if one blocks any, allow
    otherwise.  A null URL or one without ``://`` has empty host and path, no
    rule, no aliases and is allowed; null HTML has no links; repeated rows are
    judged each; an empty table gives no rows.
    """
    edges = page_links(pages, url, html)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(
            alias_key(F.col("from_url")).alias("a"), alias_key(F.col("to_url")).alias("b")))
    nodes = connected_components(edges, "a", "b")
    own = rule_match(host_of(F.col("node")), path_of(F.col("node")), rules, "verdict")
    classes = (nodes.withColumn("own", own).groupBy("component")
               .agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce(F.col("own") == "allow", F.lit(False))).alias("allowed"),
                    F.max(F.coalesce(F.col("own") == "block", F.lit(False))).alias("blocked"))
               .select("component", "n", (F.col("blocked") & ~F.col("allowed")).alias("blocked")))
    blocked = (attach(nodes, classes, "component", "n", ["node"]).filter("blocked")
               .select(F.col("node").alias("key"), F.explode(F.sequence(F.lit(1), F.lit(SPREAD))).alias("part"),
                       F.lit(True).alias("alias_blocked")))
    host, path = F.col("host"), F.col("path")
    rows = (pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"),
                         path_of(F.col(url)).alias("path"), alias_key(F.col(url)).alias("key"))
            .withColumn("rule", rule_match(host, path, rules, "name"))
            .withColumn("own", rule_match(host, path, rules, "verdict"))
            # pages with a rule need no class; a URL that many pages share is dealt out
            .withColumn("key", F.when(F.col("own").isNull(), F.col("key")))
            .withColumn("part", 1 + F.pmod(F.xxhash64("page_id"), F.lit(SPREAD)).cast("int")))
    joined = rows.join(blocked, ["key", "part"], "left")
    return joined.select(
        "page_id", "host", "path", "rule",
        F.coalesce("own", F.when(F.col("alias_blocked"), "block"), F.lit("allow")).alias("verdict"))
