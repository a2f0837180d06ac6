"""URL filter: a trie over reversed host labels, each node with a trie over path segments; the longest rule decides.

Nulls and odd rows: a null url, or one without ``://``, has an empty host and path; no rule fits it and the default
verdict holds. Repeated rows are judged one by one. An empty table gives an empty result. Only the id and the url are
read, so other columns, whatever their names, change nothing. Equal rules: the later one counts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """Fits ``host``, its subdomains, and paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass
class PathNode:
    next: dict[str, PathNode] = field(default_factory=dict)
    #: (rest of the path within the segment, rule): the rest of the url's path must start with it
    rules: list[tuple[str, Rule]] = field(default_factory=list)


@dataclass
class HostNode:
    next: dict[str, HostNode] = field(default_factory=dict)
    paths: PathNode = field(default_factory=PathNode)


def build_trie(rules: list[Rule]) -> HostNode:
    root = HostNode()
    for rule in rules:
        node = root
        for label in reversed(rule.host.split(".") if rule.host else []):
            node = node.next.setdefault(label, HostNode())
        *whole, rest = rule.path.split("/")
        path = node.paths
        for segment in whole:
            path = path.next.setdefault(segment, PathNode())
        path.rules = [x for x in path.rules if x[0] != rest] + [(rest, rule)]
    return root


def longest_match(root: HostNode, host: str, path: str) -> Rule | None:
    """The fitting rule with the longest text; of equally long ones that with the longer host."""
    best, size, node = None, (-1, -1), root
    segments = path.split("/")
    labels = host.split(".")
    while True:
        at, used = node.paths, 0
        for k, segment in enumerate(segments):
            for rest, rule in at.rules:
                key = (len(rule.text), len(rule.host))
                if key > size and path.startswith(rest, used):
                    best, size = rule, key
            at = at.next.get(segment) if k + 1 < len(segments) else None
            if at is None:
                break
            used += len(segment) + 1
        node = node.next.get(labels.pop()) if labels else None
        if node is None:
            return best


def host_of(url):
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url):
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(pages, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow"):
    """One row for each row of ``pages``: the id, host, path, the rule that decided (null: none), and the verdict.

    The trie is broadcast: its size is that of the rule list, which the caller states in the program.
    """
    trie = pages.sparkSession.sparkContext.broadcast(build_trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def decide(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        root = trie.value
        found = [longest_match(root, h, p) for h, p in zip(hosts, paths, strict=True)]
        return pd.DataFrame({
            "rule": pd.Series([r.text if r else None for r in found], dtype=object),
            "verdict": pd.Series([r.verdict if r else default for r in found], dtype=object),
        })

    url = F.col(url_col)
    split = pages.select(F.col(id_col).alias(id_col), host_of(url).alias("host"), path_of(url).alias("path"))
    judged = split.withColumn("judged", decide("host", "path"))
    return judged.select(id_col, "host", "path", "judged.rule", "judged.verdict")
