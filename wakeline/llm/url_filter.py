"""URL filter: longest-rule verdicts, carried over to aliases along redirects and canonical links.

A node is a URL without scheme and fragment, its host in lower case. Pages whose URLs are one node
share a verdict; ``<link rel="canonical">`` and ``<meta http-equiv="refresh">`` in a page, and any
redirect table given, are edges. A page that no rule fits takes its component's verdict: allow if
an allow rule fits any node of it, else block if a block rule does, else allow. Explicit rules are
never overruled. All such tags of a page count; relative targets are resolved against the page's URL
or its ``<base href>``, dot segments removed.

Defined results
    a null URL or one without ``://``: empty host and path, no node, so allow; null html: no links;
    rows repeat as often as in the input; a null page_id is kept; an empty table gives no rows; pages
    without a host, however many, are spread over the tasks of the joins; texts are searched whole; of
    rules that are equally long the allowing one wins; other columns of pages, rules and redirects, also of
    clashing names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import lower_ascii, staged


def after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(after_scheme(url), r"(?s)^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """Null for what is no absolute URL."""
    rest = F.regexp_extract(after_scheme(url), r"(?s)^[^/?#]*([^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), F.when(rest == "", "/").otherwise(rest)))


def rule_table(like: DataFrame, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """``(verdict, host/path)`` pairs as ``verdict, rule, rule_host, rule_path``."""
    rows = [(v, r, r.partition("/")[0], "/" + r.partition("/")[2]) for v, r in rules]
    return like.sparkSession.createDataFrame(rows, "verdict string, rule string, rule_host string, rule_path string")


def judged(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``host, path`` (distinct) with ``rule, verdict`` of the longest rule that fits; only those with one.

    Every host is probed by each of its domain suffixes, so the rules may be as many as they like.
    Of rules of one length on one URL, an allow goes first.
    """
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = urls.withColumn("rule_host", F.explode(suffixes)).join(rules, "rule_host").filter(F.startswith("path", F.col("rule_path")))
    best = F.max(F.struct(F.length("rule").alias("n"), (F.col("verdict") == "allow").alias("ok"), "rule", "verdict"))
    return fits.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", "best.verdict")


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), 0)


def _dotless(path: Column) -> Column:
    """A path from ``/`` on, without ``.`` and ``..`` segments."""
    step = lambda done, s: F.when(s == ".", done).when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.array_append(done, s))
    kept = lambda parts: F.aggregate(parts, F.array().cast("array<string>"), step)
    return _let(F.split(path, "/"), lambda parts: F.array_join(F.concat(kept(parts), F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))), "/"))


def resolved(url: Column, href: Column) -> Column:
    """The absolute URL of a link; without the page's scheme, which no node has."""

    def at(p: Column) -> Column:
        folder = F.regexp_extract(p["path"], r"(?s)^(.*/)", 1)
        rest = F.when(F.startswith(href, F.lit("/")), href).when(F.startswith(href, F.lit("?")), F.concat(p["path"], href)).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), href))
        cut = lambda r: _let(F.regexp_extract(r, r"(?s)^([^?#]*)", 1), lambda path: F.concat(F.when(path == "", "").otherwise(_dotless(path)), F.substr(r, F.length(path) + 1)))
        return F.when(p["host"] != "", F.concat(F.lit("x://"), p["host"], _let(rest, cut)))

    parts = F.struct(host_of(url).alias("host"), path_of(url).alias("path"))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href).when(F.startswith(href, F.lit("//")), F.concat(F.lit("x:"), href))
        .when(F.startswith(href, F.lit("#")), url).otherwise(_let(parts, at))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """``src, dst`` nodes of all canonical and refresh links."""
    value = r"\s*=\s*[\"']?([^\"'\s>]+)"
    tag = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*?\bhref" + value
    refresh = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*?\burl" + value
    plain = lambda c: F.replace(c, F.lit("&amp;"), F.lit("&"))
    all_of = lambda pattern: F.regexp_extract_all("html", F.lit(pattern), F.lit(1))
    found = pages.filter(F.col("html").rlike("(?i)canonical|http-equiv")).select("url", plain(F.regexp_extract("html", r"(?is)<base\b[^>]*?\bhref" + value, 1)).alias("base"), F.explode(F.concat(all_of(tag), all_of(refresh))).alias("href"))
    base = F.when(F.col("base") == "", F.col("url")).otherwise(F.coalesce(resolved(F.col("url"), F.col("base")), F.col("url")))
    dst = _let(base, lambda b: _let(plain(F.col("href")), lambda href: _let(resolved(b, href), node_of)))
    return staged(found.select(node_of(F.col("url")).alias("src"), dst.alias("dst")), "page-links", narrow=True).na.drop()


def filter_urls(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """``page_id, url, html`` to ``page_id, host, path, rule, verdict``, one row per input row.

    ``redirects``: further edges, columns ``src, dst`` of URLs.
    """
    links = page_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select(node_of(F.col("src")).alias("src"), node_of(F.col("dst")).alias("dst")).na.drop())
    links = staged(links.distinct(), "links", narrow=True)
    member = staged(components(links, "src", "dst"), "members", narrow=True)
    url = F.concat(F.lit("x://"), F.col("node"))
    nodes = member.withColumns({"host": host_of(url), "path": path_of(url)})
    own = judged(pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).unionByName(nodes.select("host", "path")).filter("host <> ''").distinct(), rules)
    own = staged(own, "judged", narrow=True)
    verdicts = nodes.join(own, ["host", "path"]).groupBy("component").agg(F.max(F.col("verdict") == "allow").alias("ok"))
    passed_on = member.join(verdicts, "component").select("node", F.when(F.col("ok"), "allow").otherwise("block").alias("inherited"))
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node"))
    # No host and no node looks like this, so rows without them match nothing in any task.
    nowhere = F.concat(F.lit("\n"), F.pmod(F.xxhash64("page_id"), F.lit(1 << 16)).cast("string"))
    rows = rows.withColumns({"at_host": F.when(F.col("host") == "", nowhere).otherwise(F.col("host")), "at_node": F.coalesce("node", nowhere)})
    return (
        rows.join(own.withColumnRenamed("host", "at_host"), ["at_host", "path"], "left")
        .join(passed_on.withColumnRenamed("node", "at_node"), "at_node", "left")
        .select("page_id", "host", "path", "rule", F.coalesce("verdict", "inherited", F.lit("allow")).alias("verdict"))
    )
