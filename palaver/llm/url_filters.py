"""Operator 9: URL filters by a trie over reversed host labels and path segments.

Allow and block entries (``host/path``) go into one trie: host labels from the last to the first,
then whole path segments; what an entry has after its last slash is a prefix of the next segment.
The trie is small (``MOST_RULES`` bounds it) and is broadcast; each url walks it once, and the
longest entry met wins (of two as long, a block entry, then the later one in order). Urls that no entry
fits get the default.

A null url, or one without ``://``, has an empty host and path and fits no entry. Repeated rows are
judged each; very long urls whole; other columns pass through, and columns named host, path, rule or
verdict are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, read

MOST_RULES = 200_000

#: The production list.
RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]


class Node:
    __slots__ = ("labels", "segments", "rests", "longest", "whole")

    def __init__(self):
        self.labels: dict[str, Node] = {}
        self.segments: dict[str, Node] = {}
        #: Unfinished last segments of entries: rest -> (rule, verdict).
        self.rests: dict[str, tuple[str, str]] = {}
        self.longest = -1
        #: An entry without any path.
        self.whole: tuple[str, str] | None = None


def build(rules: list[tuple[str, str]]) -> Node:
    """``rules``: (verdict, host + path)."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"over {MOST_RULES} rules: too many to broadcast")
    root = Node()
    for verdict, rule in sorted(rules):  # of equal entries, block comes last and stays
        host, slash, path = rule.partition("/")
        node = root
        for label in reversed(host.lower().split(".")):
            node = node.labels.setdefault(label, Node())
        if not slash:
            node.whole = (rule, verdict)
            continue
        *closed, rest = path.split("/")
        for segment in closed:
            node = node.segments.setdefault(segment, Node())
        node.rests[rest] = (rule, verdict)
        node.longest = max(node.longest, len(rest))
    return root


def _strength(entry: tuple[str, str]) -> tuple[int, bool, str]:
    rule, verdict = entry
    return len(rule), verdict == "block", rule


def judge(root: Node, host: str, path: str) -> tuple[str, str] | None:
    """The longest fitting (rule, verdict)."""
    best: tuple[str, str] | None = None

    def better(found: tuple[str, str]) -> None:
        nonlocal best
        if best is None or _strength(found) > _strength(best):
            best = found

    segments = path[1:].split("/") if path.startswith("/") else None
    node = root
    for label in reversed(host.split(".")):
        node = node.labels.get(label)
        if node is None:
            break
        if node.whole:
            better(node.whole)
        at = node if segments is not None else None
        for k, segment in enumerate(segments or ()):
            for n in range(min(len(segment), at.longest) + 1):
                if found := at.rests.get(segment[:n]):
                    better(found)
            at = at.segments.get(segment) if k + 1 < len(segments) else None
            if at is None:
                break
    return best


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (null: none fits) and verdict."""
    trie = pages.sparkSession.sparkContext.broadcast(build(rules))
    (said,) = fresh(pages, "judged")

    @F.pandas_udf("struct<rule: string, verdict: string>")
    def walk(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        root = trie.value
        found = [judge(root, h, p) or (None, default) for h, p in zip(hosts, paths, strict=True)]
        return pd.DataFrame(found, columns=["rule", "verdict"])

    return (
        pages.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
        .withColumn(said, walk("host", "path"))
        .withColumns({"rule": F.col(f"{said}.rule"), "verdict": F.col(f"{said}.verdict")})
        .drop(said)
    )


def op9_url_filters(spark, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


OP9_SQL = r"""
WITH u AS (
  SELECT page_id, strpos(coalesce(url, ''), '://') AS p, coalesce(url, '') AS url FROM pages
), t AS (
  SELECT page_id, CASE WHEN p > 0 THEN substr(url, p + 3) ELSE '' END AS rest FROM u
), h AS (
  SELECT page_id, regexp_extract(rest, '^([^/?#]*)', 1) AS raw,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM t
), a AS (
  SELECT page_id, path, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM h
), r(verdict, rhost, rpath) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), m AS (
  SELECT a.page_id, a.host, a.path, max_by(r.rhost || r.rpath, length(r.rhost || r.rpath)) AS rule,
         max_by(r.verdict, length(r.rhost || r.rpath)) AS verdict
  FROM a LEFT JOIN r ON (a.host = r.rhost OR ends_with(a.host, '.' || r.rhost)) AND starts_with(a.path, r.rpath)
  GROUP BY a.page_id, a.host, a.path
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m
"""
