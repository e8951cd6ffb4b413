"""URL filters by redirect equivalence.

A rule names a host with its subdomains and the beginning of a path; the longest that fits a URL decides it. URLs that
redirect to each other or name one canonical address are aliases: connected components over those links. Where a rule
blocks one URL of a component, its aliases that no rule decides are blocked too. An explicit rule always comes first, so an
allowed URL stays allowed whatever its aliases are.

Rules are found by equality joins: a URL gives one candidate for each of its host's suffixes and each length that a rule's
path has. Distinct places are judged once, and rows of hot places, rules, components and URLs stay where they are.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, hot_bound, join_hot, written
from .components import connected_components

ALLOW, BLOCK = "allow", "block"
#: Rules that are broadcast, at most; more are joined by a shuffle.
BROADCAST_RULES = 100_000
#: What follows an attribute's name: its value with or without quotes.
_VALUE = r"\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))"
LINK_TAG, META_TAG = r"(?is)<link\b[^>]*>", r"(?is)<meta\b[^>]*>"
IS_CANONICAL, IS_REFRESH = r"(?i)\srel\s*=\s*[\"']?canonical\b", r"(?i)\shttp-equiv\s*=\s*[\"']?refresh\b"
HREF, CONTENT, TARGET = rf"(?i)\shref{_VALUE}", rf"(?i)\scontent{_VALUE}", r"(?i)url\s*=\s*['\"]?([^'\"]+)"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """What stands from the first :// up to /, ?, # or the end, A-Z lower-cased; empty without :// or for null."""
    return ascii_lower(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without :// or for null."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def address(url: Column) -> Column:
    """The URL without its fragment, scheme and host lower-cased: what aliases are told by; null without ://."""
    scheme = ascii_lower(F.substring(url, F.lit(1), F.instr(url, "://") + 2))
    rest = F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(scheme, host_of(url), rest))


def _attribute(tag: Column, pattern: str) -> Column:
    return F.concat(*(F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)))


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst): addresses of pages and of what their canonical links and refresh redirects point to.

    Relative targets are taken against the page's address (dot segments stay as written); fragments alone and other
    schemes (mailto:) give no row. Pages without an address or with null html give none.
    """
    url, html = F.col(url_col), F.col(html_col)
    canonical = F.transform(F.filter(F.regexp_extract_all(html, F.lit(LINK_TAG), F.lit(0)), lambda t: t.rlike(IS_CANONICAL)), lambda t: _attribute(t, HREF))
    refresh = F.transform(F.filter(F.regexp_extract_all(html, F.lit(META_TAG), F.lit(0)), lambda t: t.rlike(IS_REFRESH)), lambda t: F.regexp_extract(_attribute(t, CONTENT), TARGET, 1))
    told = pages.where(html.rlike("(?i)canonical|http-equiv")).select(url.alias("url"), F.explode(F.concat(canonical, refresh)).alias("to"))
    to = F.replace(F.trim("to"), F.lit("&amp;"), F.lit("&"))
    scheme = F.substring("url", F.lit(1), F.instr("url", "://") - 1)
    origin = F.concat(scheme, F.lit("://"), host_of(F.col("url")))
    path = path_of(F.col("url"))
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, r"(?s)^.*/", 0))
    target = (
        F.when(to.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), to)
        .when(to.rlike("^([A-Za-z][A-Za-z0-9+.-]*:|#|$)"), F.lit(None))
        .when(to.startswith("//"), F.concat(scheme, F.lit(":"), to))
        .when(to.startswith("/"), F.concat(origin, to))
        .when(to.startswith("?"), F.concat(origin, path, to))
        .otherwise(F.concat(origin, folder, to))
    )
    return told.select(address(F.col("url")).alias("src"), address(target).alias("dst")).where("src <> dst")


def _rule_table(spark, rules: Iterable[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """(rule, action), rule being host and path in one; of two actions for one rule allow comes first."""
    table = rules if isinstance(rules, DataFrame) else spark.createDataFrame(list(rules), "action string, host string, path string")
    table = table.where("action IN ('allow', 'block') AND host <> '' AND (path = '' OR path LIKE '/%')")
    return table.groupBy(F.concat(ascii_lower(F.col("host")), "path").alias("rule")).agg(F.min("action").alias("action"))


def ruled(places: DataFrame, rules: DataFrame) -> DataFrame:
    """(place, rule, action) for each distinct place (a host and a path in one); nulls where no rule fits.

    The longest rule wins; of equally long ones that with the longer host.
    """
    host, path = F.regexp_extract("rule", "^[^/]*", 0), F.regexp_extract("rule", "(?s)^[^/]*(.*)", 1)
    shape = rules.agg(F.collect_set(F.length(path)).alias("lengths"), F.max(F.size(F.split(host, r"\."))).alias("labels"), F.count(F.lit(1)).alias("n")).first()
    lengths, labels = F.array(*(F.lit(n) for n in sorted(shape["lengths"]))), F.split(F.regexp_extract("place", "^[^/]*", 0), r"\.")
    own, own_path = F.size(labels), F.regexp_extract("place", "(?s)^[^/]*(.*)", 1)
    suffixes = F.transform(F.sequence(F.lit(1), F.least(own, F.lit(shape["labels"] or 1))), lambda k: F.array_join(F.slice(labels, own - k + 1, k), "."))
    fitting = F.filter(lengths, lambda n: n <= F.length(own_path))
    every = F.flatten(F.transform(suffixes, lambda h: F.transform(fitting, lambda n: F.concat(h, F.substring(own_path, F.lit(1), n)))))
    asked = places.select("place", F.explode_outer(every).alias("rule"))
    if shape["n"] <= BROADCAST_RULES:
        met = asked.join(F.broadcast(rules), "rule", "left")
    else:
        asked = written(asked)
        hits = rules.join(asked.groupBy("rule").agg(F.count(F.lit(1)).alias("n")), "rule")
        met = join_hot(asked, hits, "rule", F.col("n") > hot_bound(asked.count()), "left")
    fit = F.when(F.col("action").isNotNull(), F.struct(F.length("rule").alias("size"), F.length(host).alias("host"), "rule", "action"))
    return met.groupBy("place").agg(F.max(fit).alias("fit")).select("place", "fit.rule", "fit.action")


def blocked_addresses(links: DataFrame, rules: DataFrame) -> DataFrame:
    """(address): every address of links that can reach, over links in either direction, one that a rule blocks."""
    labels = written(connected_components(links.select("src", "dst"), "src", "dst"))
    node = F.col("node")
    places = labels.select(F.concat(host_of(node), path_of(node)).alias("place"), "component")
    acts = ruled(places.select("place").distinct(), rules).where(F.col("action") == BLOCK).select("place")
    counts = places.groupBy("place").agg(F.count(F.lit(1)).alias("n"))
    most = hot_bound(labels.count())
    bad = join_hot(places, acts.join(counts, "place"), "place", F.col("n") > most).select("component").distinct()
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return join_hot(labels, bad.join(sizes, "component"), "component", F.col("n") > most).select(node.alias("address"))


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]] | DataFrame, links: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, host, path, rule, verdict, aliased: one row per row of pages.

    rules: (action, host, path) with action allow or block; links: (src, dst) of redirects and canonical addresses, by
    default those that the pages' html names. A rule fits its host and its subdomains where the path begins with the
    rule's; the longest decides, and then aliased is false. Without a rule the verdict is block where an alias is blocked
    by its rule (aliased is true), else allow.

    Null URLs and URLs without :// have empty host and path, no rule, no alias, and are allowed. Repeated rows give a row
    each; ids may be null; very long URLs are read whole; other columns are ignored; empty tables give no rows, empty rules
    allow everything.
    """
    url = F.col(url_col)
    table = written(_rule_table(pages.sparkSession, rules))
    if links is None:
        links = page_links(pages, url_col, html_col)
    else:
        links = links.select(address(F.col("src")).alias("src"), address(F.col("dst")).alias("dst"))
    rows = pages.select(F.col(id_col).alias("id"), address(url).alias("address"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = written(rows.withColumn("place", F.concat("host", "path")))
    most = hot_bound(rows.count())
    judged = ruled(rows.select("place").distinct(), table)
    counts = rows.groupBy("place").agg(F.count(F.lit(1)).alias("n"))
    found = join_hot(rows, judged.join(counts, "place"), "place", F.col("n") > most)
    blocked = written(blocked_addresses(links, table))
    counts = rows.groupBy("address").agg(F.count(F.lit(1)).alias("n"))
    alias = blocked.join(counts, "address").select("address", "n", F.lit(True).alias("alias"))
    found = join_hot(found.drop("n"), alias, "address", F.col("n") > most, "left")
    aliased = F.col("rule").isNull() & F.coalesce("alias", F.lit(False))
    verdict = F.coalesce("action", F.when(aliased, F.lit(BLOCK)).otherwise(F.lit(ALLOW)))
    return found.select("id", "host", "path", "rule", verdict.alias("verdict"), aliased.alias("aliased"))
