"""URL rules by a sorted sweep over reversed hosts.

The labels of a host are reversed, ``www.example.com`` to ``com.example.www.``, so a host and all its subdomains are one interval of
keys, and intervals are nested or apart. Rules and urls are dealt to ranges of keys and sorted together. The sweep through
a range keeps a stack of the rules' hosts that are open at the current key; a url is judged by the stack alone.

The ranges are cut at keys of a sample (a fixed number for each range) and, among equal keys, at a hash of the row, so a host with a third of all urls is dealt to many
ranges. A rule goes to each range that its interval touches. The sweep holds no more than the rules that are open at one key.

A rule fits if its host does and the path starts with its path. Of those that fit the longest one (host and path) wins, then the
one with the longer host, then block. A url that no rule fits is allowed.

Defined: no url, or one without ``://``, has an empty host and path. An empty rule host fits every url. Rules and urls may repeat. Without rules all
is allowed.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

SAMPLE = 50
TOP = "\U0010ffff"


def host_of(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 2)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host: Column) -> Column:
    """``www.example.com`` as ``com.example.www.``; an empty host as an empty key."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


class Stack:
    """The open hosts of the rules, outermost first, each with its rules by path."""

    def __init__(self):
        self.nodes: list[tuple[str, dict[str, tuple[str, str]], list[int]]] = []

    def close(self, key: str) -> None:
        while self.nodes and not key.startswith(self.nodes[-1][0]):
            self.nodes.pop()

    def add(self, key: str, path: str, verdict: str, rule: str) -> None:
        self.close(key)
        if not self.nodes or self.nodes[-1][0] != key:
            self.nodes.append((key, {}, []))
        _, rules, sizes = self.nodes[-1]
        if path not in rules or verdict == "block":
            rules[path] = (verdict, rule)
        if len(path) not in sizes:
            sizes.append(len(path))
            sizes.sort(reverse=True)

    def judge(self, key: str, path: str) -> tuple[str | None, str]:
        self.close(key)
        best, found = (-1, -1), (None, "allow")
        for host, rules, sizes in self.nodes:
            for n in sizes:
                if n <= len(path) and path[:n] in rules:
                    verdict, rule = rules[path[:n]]
                    if (len(rule), len(host)) > best:
                        best, found = (len(rule), len(host)), (rule, verdict)
                    break
        return found


def _dealt(bounds: list[tuple[str, int]]):
    """The range of each row; of a rule all the ranges that its interval touches."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            low = [bisect_right(bounds, x) if kind else bisect_right(bounds, (x[0], -(1 << 63))) for x, kind in zip(zip(rows["key"], rows["tie"], strict=True), rows["kind"], strict=True)]
            high = [n if kind else bisect_right(bounds, (key + TOP, 0)) for n, key, kind in zip(low, rows["key"], rows["kind"], strict=True)]
            rows["part"] = [list(range(a, b + 1)) for a, b in zip(low, high, strict=True)]
            yield rows.explode("part", ignore_index=True)

    return deal


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    stack, part = Stack(), None
    for rows in batches:
        out = []
        for r in rows.itertuples(index=False):
            if r.part != part:
                stack, part = Stack(), r.part
            if r.kind == 0:
                stack.add(r.key, r.path, r.verdict, r.rule)
            else:
                rule, verdict = stack.judge(r.key, r.path)
                out.append((r.id, r.none, r.host, r.path, rule, verdict))
        yield pd.DataFrame(out, columns=["id", "none", "host", "path", "rule", "verdict"]).astype({"id": "int64", "none": "bool"})


def judged(urls: DataFrame, rules: DataFrame, id_column: str = "page_id", url: str = "url") -> DataFrame:
    """A row per row of ``urls``: id, host, path, rule, verdict. ``rules`` has host, path and verdict (allow or block)."""
    spark = urls.sparkSession
    host, path = host_of(F.col(url))
    # Ids are never null in pandas, where numbers beside nulls become floats.
    own = F.col(id_column).cast("long")
    mine = urls.select(F.coalesce(own, F.lit(0)).alias("id"), own.isNull().alias("none"), host.alias("host"), path.alias("path"), F.xxhash64(F.monotonically_increasing_id()).alias("tie"))
    none = F.lit(None).cast("string")
    mine = mine.select("id", "none", "host", "path", "tie", host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), none.alias("verdict"), none.alias("rule"))
    given = rules.filter(F.col("host").isNotNull() & F.col("path").isNotNull()).select(
        F.lit(0).cast("long").alias("id"), F.lit(True).alias("none"), F.lower("host").alias("host"), "path", F.lit(0).cast("long").alias("tie"),
        host_key(F.lower("host")).alias("key"), F.lit(0).alias("kind"), "verdict", F.concat(F.lower("host"), F.col("path")).alias("rule"),
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    count = mine.count()
    share = min(1.0, SAMPLE * parts / max(1, count))
    # Any keys will do as bounds, so long ones are cut.
    drawn = sorted((r.key, r.tie) for r in mine.select(F.substring("key", 1, 256).alias("key"), "tie").sample(share, 7).collect())
    bounds = sorted({drawn[k * len(drawn) // parts] for k in range(1, parts)}) if drawn else []
    columns = "id long, none boolean, host string, path string, tie long, key string, kind int, verdict string, rule string, part long"
    dealt = mine.unionByName(given).mapInPandas(_dealt(bounds), columns)
    ordered = dealt.repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("part", "key", "kind", "tie")
    swept = ordered.mapInPandas(_sweep, "id long, none boolean, host string, path string, rule string, verdict string")
    return swept.select(F.when(~F.col("none"), F.col("id")).alias("id"), "host", "path", "rule", "verdict")
