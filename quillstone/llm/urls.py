"""URL filters: a trie over reversed host labels and path segments, broadcast, longest match first.

The trie is small by contract (``MAX_RULES``, checked) and reaches every task as one broadcast value; the corpus is
neither shuffled nor joined.  Looking a URL up costs its own length, whatever the number of rules.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no rule and gets the default
verdict; repeated URLs are judged one by one; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import map_rows

#: More rules than this do not belong in a broadcast value (about 100 MB).
MAX_RULES = 1_000_000


class RuleTrie:
    """Allow and block rules ``host/path``; a rule holds for its host, all subdomains and all longer paths.

    Nodes are dictionaries.  Below the node of a host (labels from the right) hangs a second trie over the path's
    whole segments; a path's last, possibly unfinished segment is kept as a prefix in its parent.
    """

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.root: dict = {}
        for number, (verdict, rule) in enumerate(rules):
            if number >= MAX_RULES:
                raise ValueError(f"more than {MAX_RULES} rules")
            if verdict not in ("allow", "block"):
                raise ValueError(f"unknown verdict {verdict}")
            host, slash, path = rule.partition("/")
            node = self.root
            for label in reversed(host.lower().split(".")):
                node = node.setdefault(label, {})
            *whole, last = (slash + path).split("/")
            node = node.setdefault(None, {})  # a host label is never None: here the path trie begins
            for segment in whole:
                node = node.setdefault(segment, {})
            node.setdefault(None, {})[last] = (rule, verdict)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest fitting rule; of equal length the one with the longer host."""
        best, node = None, self.root
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            paths = node.get(None)
            hit = paths and self._path(paths, path)
            if hit and (best is None or len(hit[0]) >= len(best[0])):
                best = hit
        return best

    @staticmethod
    def _path(node: dict, path: str) -> tuple[str, str] | None:
        best = None
        for segment in path.split("/"):
            ends = node.get(None)
            if ends:
                # at most len(segment) + 1 look-ups, whatever the number of rules that end here
                for cut in range(len(segment), -1, -1):
                    hit = ends.get(segment[:cut])
                    if hit:
                        best = hit
                        break
            node = node.get(segment)
            if node is None:
                break
        return best


def split_url(df: DataFrame, url: str) -> DataFrame:
    """Adds ``host`` and ``path``: host up to ``/``, ``?``, ``#`` (A-Z lower-cased), path up to ``?``, ``#``."""
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return df.withColumn("host", lower).withColumn("path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def filter_urls(df: DataFrame, rules: Iterable[tuple[str, str]], key: str, url: str, default: str = "allow") -> DataFrame:
    """``key``, ``host``, ``path``, ``rule`` and ``verdict`` of every row; without a fitting rule ``default``."""
    trie = df.sparkSession.sparkContext.broadcast(RuleTrie(list(rules)))
    parts = split_url(df.select(F.col(key).alias("key"), F.col(url).alias("url")), "url").drop("url")

    def work(batch: pa.RecordBatch):
        found = [trie.value.find(h, p) for h, p in zip(batch["host"].to_pylist(), batch["path"].to_pylist())]
        yield [
            batch["key"].cast(pa.int64()), batch["host"].cast(pa.string()), batch["path"].cast(pa.string()),
            [f and f[0] for f in found], [f[1] if f else default for f in found],
        ]

    return map_rows(parts, work, "key bigint, host string, path string, rule string, verdict string").withColumnRenamed("key", key)
