"""URL filters with redirect equivalence, in built-in functions only.

Rules name a host and a path prefix, with block or allow. A rule fits its host
and all subdomains; of several the longest wins. Pages are then joined by
their redirect and canonical-link targets into classes of aliases, and a
blocked member blocks the others. An explicit allow rule takes precedence: a
url that one fits stays allowed whatever its class holds.

Links are taken from the page itself: ``<link rel="canonical" href>`` and
``<meta http-equiv="refresh" content="0; url=...">``; more edges can be given
as a table. Targets are resolved against the page's url, with ``.`` and ``..``
folded. Urls are compared without scheme and fragment, an empty path as ``/``.
Targets that are not
pages themselves are judged by the rules too and pass their decision on.

Defined results: a null url, or one without ``://``, has an empty host and
path, fits no rule and is allowed; null html has no links; repeated rows are
judged alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightlens.llm.components import connected_components
from freightlens.plans.session import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CANONICAL = r"(?i)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH = (
    r"(?i)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)"
    r"[^>]*?\bcontent\s*=\s*[\"']?\s*[0-9.]*\s*[;,]\s*url\s*=\s*'?([^\"'\s>]+)"
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, in lower case."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """The url as a node: host, path and query, without scheme and fragment;
    an empty path is ``/``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    rest = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    has_host = url.contains("://")
    return F.when(has_host, F.concat(host_of(url), rest))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, as a struct ``(rule, verdict)``, else null.
    ``rules`` are ``(pattern, verdict)``, a pattern being host and path like
    ``example.net/en/``. Few rules make one expression over the row."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for pattern, verdict in sorted(rules, key=lambda r: len(r[0])):  # the longest is tried first
        own_host, _, own_path = pattern.partition("/")
        fits = (host == own_host) | host.endswith("." + own_host)
        fits = fits & path.startswith("/" + own_path)
        named = F.struct(F.lit(pattern).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, named).otherwise(found)
    return found


def _folded(path: Column) -> Column:
    """A path from the root with ``.`` and ``..`` resolved."""
    none = F.array().cast("array<string>")
    parts = F.split(F.regexp_replace(path, r"(^|/)(\.\.?)$", "$1$2/"), "/")
    kept = F.aggregate(
        F.slice(parts, 2, F.size(parts)),
        none,
        lambda found, part: F.when(part == "..", F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0))))
        .when(part == ".", found)
        .otherwise(F.concat(found, F.array(part))),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def links_in(html: Column, url: Column) -> Column:
    """The nodes that a page names as its canonical url or redirects to.
    Targets without a scheme are read against ``url``: from its root, its
    folder, its path (``?``) or itself (``#``). Other schemes name no page."""
    folder = F.regexp_replace(path_of(url), r"[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)

    def absolute(target: Column) -> Column:
        target = F.replace(target, F.lit("&amp;"), F.lit("&"))
        root = F.concat(scheme, F.lit("://"), host_of(url))
        own = F.regexp_extract(target, r"(?s)^([^?#]*)", 1)  # path
        rest = F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
        relative = (
            F.when(target.startswith("#"), url)
            .when(target.startswith("?"), F.concat(root, path_of(url), target))
            .when(target.startswith("/"), F.concat(root, _folded(own), rest))
            .otherwise(F.concat(root, _folded(F.concat(folder, own)), rest))
        )
        return (
            F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
            .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
            .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
            .when((target != "") & url.contains("://"), relative)
        )

    named = [F.nullif(F.regexp_extract(html, p, 1), F.lit("")) for p in (CANONICAL, REFRESH)]
    return F.array_compact(F.array(*[node_of(absolute(t)) for t in named]))


def judge_urls(
    pages: DataFrame,
    rules: list[tuple[str, str]],
    edges: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str | None = "html",
) -> DataFrame:
    """Every row of ``pages`` as ``(id, url, host, path, rule, verdict,
    by_alias)``; ``by_alias`` tells a block that an alias passed on. ``edges``
    are more redirects, as urls in ``src`` and ``dst``."""
    spark = pages.sparkSession
    url = F.col(f"`{url_col}`")
    rows = pages.select(
        F.col(f"`{id_col}`").alias("id"),
        url.alias("url"),
        host_of(url).alias("host"),
        path_of(url).alias("path"),
        node_of(url).alias("node"),
    )
    rows = rows.withColumn("r", rule_for(F.col("host"), F.col("path"), rules))

    links = []
    if html_col is not None:
        targets = F.explode(links_in(F.col(f"`{html_col}`"), url))
        links.append(pages.select(node_of(url).alias("a"), targets.alias("b")))
    if edges is not None:
        links.append(edges.select(node_of(F.col("src")).alias("a"), node_of(F.col("dst")).alias("b")))
    if not links:
        return _named(rows.withColumn("by_alias", F.lit(False)))
    found = links[0]
    for more in links[1:]:
        found = found.unionByName(more)
    found = materialise(spark, found.where("a <> b").distinct(), "alias-links")
    classes = materialise(spark, connected_components(found), "alias-classes")

    # The nodes carry host and path, so the rules judge them as they are.
    node_host = F.regexp_extract("node", r"(?s)^([^/?#]*)", 1)
    node_path = F.regexp_extract("node", r"(?s)^[^/?#]*([^?#]*)", 1)
    judged = classes.withColumn("r", rule_for(node_host, node_path, rules))
    blocked = judged.where(F.col("r.verdict") == "block").select("component").distinct()
    blocked = materialise(spark, blocked, "blocked-classes")
    aliases = classes.join(blocked, "component", "left_semi").select("node")
    aliases = materialise(spark, aliases.withColumn("by_alias", F.lit(True)), "blocked-aliases")
    return _named(rows.join(aliases, "node", "left"))


def _named(rows: DataFrame) -> DataFrame:
    passed_on = F.coalesce("by_alias", F.lit(False)) & F.col("r").isNull()
    verdict = F.coalesce("r.verdict", F.when(passed_on, F.lit("block")).otherwise(F.lit("allow")))
    return rows.select(
        "id",
        "url",
        "host",
        "path",
        F.col("r.rule").alias("rule"),
        verdict.alias("verdict"),
        passed_on.alias("by_alias"),
    )
