"""URL filters: a broadcast trie over reversed host labels and path segments, the longest match decides."""

from __future__ import annotations

import bisect
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modstream.llm.common import LOWER, UPPER

#: A trie of more rules than this is refused: it is sent to every executor.
MOST_RULES = 1_000_000

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

FIELDS = "host string, path string, rule string, verdict string"


class UrlTrie:
    """Rules by host labels from the right, then by path segments.

    A node is a dict: a label or segment leads to a dict, and "" holds what ends there: {last piece of the path: (rule, verdict)}, and
    the lengths of those pieces in order. A last piece needs no slash after it and stands for any segment that begins with it.
    """

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.root: dict = {}
        n = 0
        for verdict, rule in rules:
            n += 1
            if n > MOST_RULES:
                raise ValueError(f"more than {MOST_RULES} rules")
            if verdict not in ("allow", "block"):
                raise ValueError(f"a rule allows or blocks, not {verdict!r}")
            host, slash, path = rule.partition("/")
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault("/", {})  # no label is a slash
            *segments, last = (slash + path).split("/")
            for segment in segments:
                node = node.setdefault("/" + segment, {})
            ends, lengths = node.setdefault("", ({}, []))
            # Of the same rule twice the block stands.
            if ends.get(last, ("", ""))[1] != "block":
                ends[last] = (rule, verdict)
            if len(last) not in lengths:
                bisect.insort(lengths, len(last))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest rule, host labels first, then path, that fits; its text and verdict."""
        best = None
        node = self.root
        segments = None
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            paths = node.get("/")
            if paths is not None:
                segments = path.split("/") if segments is None else segments
                best = self._path(paths, segments) or best
        return best

    @staticmethod
    def _path(node: dict, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for segment in segments:
            ends, lengths = node.get("", (None, ()))
            for n in lengths:
                if n > len(segment):
                    break
                best = ends.get(segment[:n], best)
            node = node.get("/" + segment)
            if node is None:
                break
        return best


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty without "://"."""
    known = F.coalesce(url, F.lit("")).contains("://")
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    return F.when(known, host).otherwise(""), F.when(known, path).otherwise("")


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of every url of ``pages`` (page_id, url).

    The trie of the rules (at most MOST_RULES, else ValueError) is broadcast; rows aren't shuffled. The longest rule wins:
    more host labels first, then more of the path; of the same rule as allow and block, block. A url that no rule fits, null
    and malformed ones among them, gets a null rule and ``default``. Repeated rows and null ids are judged each; no rows give
    no rows; other columns are not read. A host is taken as written, with any port or user name.
    """
    trie = pages.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    @F.pandas_udf("rule string, verdict string")
    def judged(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        find = trie.value.find
        found = [find(h, p) or (None, default) for h, p in zip(host, path, strict=True)]
        return pd.DataFrame(found, columns=["rule", "verdict"], dtype=object)

    host, path = split_url(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    return parts.withColumn("found", judged("host", "path")).select("page_id", "host", "path", "found.rule", "found.verdict")
