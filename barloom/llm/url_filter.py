"""URL filters: a trie over reversed host labels and path segments, longest match first.

A rule (action, host, path) fits its host and all subdomains, if the url's path
starts with the rule's.  Of the rules that fit, the one with the most host labels
decides, then the one with the longest path; where an entry is in both lists, block
decides.  The trie has the host's labels from the right; each host that has rules
carries a trie of its paths' whole segments, and what is left of a path after its
last slash is looked up by length.  So a url costs a step a label and a segment,
whatever the number of rules.

Scale: narrow, no shuffle.  The trie is broadcast if the rules have at most
``max_bytes``; longer lists are joined with the distinct urls by (host, directory),
each url giving a row per pair of a host suffix and a directory of its own.

Cases: the host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end,
A-Z lower-cased, ports and users included; the path goes on up to ``?``, ``#`` or the
end; a null url, or one without ``://``, has both empty.  Where no rule fits, ``rule``
is null and the verdict is ``default``.  A null or repeated identifier is a row of its
own; a null host or path of a rule counts as empty, and an empty host fits every url;
no rules and empty tables are fine; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .store import join_counted, small_batches, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"
RULES = "action string, host string, path string"
MAX_BYTES = 32 << 20


def url_host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _SPLIT, 1), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit(""))


class _Node:
    """A state of the trie: next labels or segments, ends by the path's last part, and the paths of a host."""

    __slots__ = ("ends", "lengths", "next", "paths")

    def __init__(self):
        self.next: dict[str, _Node] = {}
        self.ends: dict[str, tuple[str, str]] = {}
        self.lengths: list[int] = []
        self.paths: _Node | None = None

    def step(self, part: str) -> _Node:
        node = self.next.get(part)
        if node is None:
            node = self.next[part] = _Node()
        return node


class UrlTrie:
    """Rules in a trie; :meth:`find` gives (rule, action) or None."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root = _Node()
        for action, host, path in rules:
            node = self.root
            if host:
                for label in reversed(host.split(".")):
                    node = node.step(label)
            if node.paths is None:
                node.paths = _Node()
            node = node.paths
            *segments, last = path.split("/")
            for segment in segments:
                node = node.step(segment)
            if node.ends.get(last, ("", ""))[1] != "block":
                node.ends[last] = (host + path, action)
            if len(last) not in node.lengths:
                node.lengths = sorted([*node.lengths, len(last)], reverse=True)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        node, hosts = self.root, []
        for label in [None, *reversed(host.split("."))]:
            if label is not None:
                node = node.next.get(label)
                if node is None:
                    break
            if node.paths is not None:
                hosts.append(node.paths)
        for paths in reversed(hosts):
            found = _longest(paths, path)
            if found:
                return found
        return None


def _longest(node: _Node | None, path: str) -> tuple[str, str] | None:
    at, best = 0, None
    while node is not None:
        for n in node.lengths:
            found = node.ends.get(path[at : at + n])
            if found:
                best = found
                break
        slash = path.find("/", at)
        if slash < 0:
            break
        node, at = node.next.get(path[at:slash]), slash + 1
    return best


def _by_trie(urls: DataFrame, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    trie = urls.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    @F.pandas_udf("rule string, action string")
    def find(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in parts:
            found = [trie.value.find(h, p) or (None, None) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame(found, columns=["rule", "action"])

    return urls.withColumn("found", find("host", "path")).select("id", "host", "path", "found.rule", "found.action")


def _by_join(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The same by joins, for lists too long for a worker's memory."""
    urls = written(urls, "urls")
    labels, segments = F.split("host", r"\."), F.split("path", "/")
    last = F.element_at(segments, -1)
    part = F.struct(F.when(F.col("host") == "", 0).otherwise(F.size(labels)).alias("labels"), F.length("path").alias("length"), (F.col("action") == "block").alias("block"))
    found = rules.select(
        F.concat_ws("\n", "host", F.expr("substring_index(path, '/', size(split(path, '/')) - 1)"), F.size(segments)).alias("key"),
        F.struct(part.alias("rank"), last.alias("last"), F.concat("host", "path").alias("rule"), "action").alias("entry"),
    )
    entries = found.groupBy("key").agg(F.collect_set("entry").alias("entries"))

    # No rule looks at more labels, segments or letters of a last part than these.
    most = rules.agg(*(F.coalesce(F.max(x), F.lit(1)).cast("int") for x in (F.size(labels), F.size(segments), F.length(last)))).first()
    counted = urls.groupBy("host", "path").agg(F.count("*").alias("n"))
    upto = lambda parts, n: F.sequence(F.lit(1), F.least(F.size(parts), F.lit(n)))
    suffixes = F.concat(F.array(F.lit("")), F.transform(upto(labels, most[0]), lambda k: F.array_join(F.slice(labels, -k, k), ".")))
    begun = lambda k: F.array_join(F.slice(segments, 1, k - 1), "/")
    rest = lambda k: F.substring("path", F.length(begun(k)) + F.when(k > 1, 2).otherwise(1), F.lit(most[2]))
    dirs = F.transform(upto(segments, most[1]), lambda k: F.struct(k.alias("k"), begun(k).alias("dir"), rest(k).alias("rest")))
    rows = (
        counted.select("host", "path", F.explode(F.array_distinct(suffixes)).alias("suffix"), segments.alias("segments"))
        .select("host", "path", "suffix", F.explode(dirs).alias("d"))
        .select("host", "path", F.col("d.rest").alias("rest"), F.concat_ws("\n", "suffix", "d.dir", "d.k").alias("key"))
    )
    rows = written(rows, "url-keys")
    per_key = rows.groupBy("key").agg(F.count("*").alias("rows")).join(entries, "key")
    fits = join_counted(rows, per_key, "key", "rows").select("host", "path", "rest", F.explode("entries").alias("e")).filter(F.expr("startswith(rest, e.last)"))
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct("e.rule", "e.action"), "e.rank").alias("found"))
    url = F.struct("host", "path")
    judged = counted.join(best, ["host", "path"], "left").select(url.alias("url"), "n", "found")
    back = join_counted(urls.select("id", url.alias("url")), judged, "url", "n")
    return back.select("id", "url.host", "url.path", "found.rule", "found.action")


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """Rules (action, host, path) as a table."""
    return spark.createDataFrame(list(rules), RULES)


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    default: str = "allow",
    max_bytes: int = MAX_BYTES,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """One row per page: the identifier, host, path, rule (host and path of the rule that decides), verdict."""
    small_batches(pages.sparkSession)
    rules = rules.select("action", F.translate(F.coalesce("host", F.lit("")), _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    urls = pages.select(F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    size = rules.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + 16), F.lit(0))).first()[0]
    found = _by_trie(urls, map(tuple, rules.collect())) if size <= max_bytes else _by_join(urls, rules)
    return found.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict"))
