"""URL filters: allow and block rules in a trie over reversed host labels, then path segments."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path): "allow" or "block".
Rule = tuple[str, str, str]

_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: The trie is sent to every executor while the rules have at most so many characters; longer lists are joined.
TRIE_CHARS = 32_000_000


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null and where there is no "://"."""
    found = _URL.search(url or "")
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


class UrlTrie:
    """Longest match: most host labels first, then the longest path; of one host and path, block goes before allow."""

    def __init__(self, rules: Iterable[Rule]) -> None:
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            *segments, last = path.split("/")
            node = node.setdefault(None, {})  # the paths of this host
            for segment in segments:
                node = node.setdefault(segment, {})
            ends = node.setdefault(None, {})  # what a segment may begin with
            if ends.get(last, ("allow",))[0] == "allow":
                ends[last] = verdict, host + path

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, rule) or None."""
        best, node = None, self.root
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if None in node:
                best = self._longest(node[None], segments) or best
        return best

    @staticmethod
    def _longest(node: dict, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for segment in segments:
            fits = [start for start in node.get(None, ()) if segment.startswith(start)]
            if fits:
                best = node[None][max(fits, key=len)]
            node = node.get(segment)
            if node is None:
                break
        return best


def _judge(trie: UrlTrie, default: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [split_url(u) for u in batch.column("url").to_pylist()]
            found = [trie.match(*p) for p in parts]
            columns = [[p[0] for p in parts], [p[1] for p in parts], [f and f[1] for f in found], [f[0] if f else default for f in found]]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *(pa.array(c, pa.string()) for c in columns)], ["page_id", "host", "path", "rule", "verdict"])

    return run


def _judge_by_join(pages: DataFrame, rules: Sequence[Rule], default: str) -> DataFrame:
    """The same answers by an equi-join on (host suffix, path up to a slash), for lists too long to send around."""
    spark = pages.sparkSession
    listed = spark.createDataFrame([(v, h, p, p[: p.rfind("/") + 1]) for v, h, p in rules], "verdict string, rule_host string, rule_path string, folder string")
    urls = pages.select(
        "url",
        F.translate(F.regexp_extract("url", _URL.pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"),
        F.regexp_extract("url", f"(?s){_URL.pattern}", 2).alias("path"),
    ).distinct()
    labels, segments = F.split("host", "[.]"), F.split("path", "/", -1)
    keys = urls.withColumn("suffix", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")))).withColumn(
        "folder", F.explode(F.transform(F.sequence(F.lit(0), F.size(segments) - 1), lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(segments, 1, k), "/"), F.lit("/")))))
    )
    rank = F.struct(F.size(F.split("rule_host", "[.]")), F.length("rule_path"), F.col("verdict") == "block")
    best = (
        keys.join(listed, (F.col("suffix") == F.col("rule_host")) & (keys["folder"] == listed["folder"]) & F.col("path").startswith(F.col("rule_path")))
        .groupBy("url")
        .agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "verdict"), rank).alias("best"))
    )
    return (
        pages.select("page_id", "url").join(urls, "url", "left").join(best, "url", "left")
        .select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "best.rule", F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    )


def judge_urls(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", trie_chars: int = TRIE_CHARS) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages.

    A rule (verdict, host, path) fits its host and all subdomains where the url's path starts with the rule's; the
    longest wins. rule is host + path of the winner or null, then verdict is `default`. A null url, and one without
    "://", has empty host and path; so has no rule. Repeated pages are judged one by one; no rows give no rows; other
    columns are not read. Rules of more than trie_chars characters are joined instead of broadcast.
    """
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"))
    if sum(len(h) + len(p) for _, h, p in rules) > trie_chars:
        return _judge_by_join(pages, rules, default)
    return pages.mapInArrow(_judge(UrlTrie(rules), default), "page_id long, host string, path string, rule string, verdict string")
