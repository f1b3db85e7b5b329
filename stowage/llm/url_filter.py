"""URL filters: a trie over reversed host labels and path segments, broadcast to the tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules in one broadcast trie; longer lists are judged in several passes, and the longest match over all passes wins.
MAX_BROADCAST_RULES = 500_000

Rule = tuple[str, str, str]  # host, path, verdict


def build_trie(rules: list[Rule]) -> dict:
    """Nested dictionaries: host labels from the last to the first, then, below the key "/", path segments.

    A node's "" holds what ends there by its unfinished last segment, (rule, verdict), which is matched as a prefix,
    and its "#" the lengths of these, longest first.  Of equal rules with different verdicts, block wins.
    """
    root: dict = {}
    for host, path, verdict in sorted(rules, key=lambda r: r[2]):
        node = root
        for label in reversed(host.split(".")):
            node = node.setdefault("." + label, {})
        *whole, last = path.split("/")
        node = node.setdefault("/", {})
        for segment in whole:
            node = node.setdefault("/" + segment, {})
        ends = node.setdefault("", {})
        ends[last] = (host + path, verdict)  # sorted: block comes last
        node.setdefault("#", set()).add(len(last))
    stack = [root]
    while stack:
        for name, below in stack.pop().items():
            if name.startswith((".", "/")):
                stack.append(below)
                if "#" in below:
                    below["#"] = sorted(below["#"], reverse=True)
    return root


def longest_match(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """Rule and verdict of the entry with most host labels, then the longest path, that fits; None if none does."""
    node, below = trie, []
    for label in reversed(host.split(".")):
        node = node.get("." + label)
        if node is None:
            break
        if "/" in node:
            below.append(node["/"])
    segments = path.split("/")
    for node in reversed(below):
        best = None
        for segment in segments:
            ends = node.get("", {})
            # one look-up for each length that ends here; a deeper node's rule is longer than any of these
            best = next((ends[segment[:n]] for n in node.get("#", ()) if n <= len(segment) and segment[:n] in ends), best)
            node = node.get("/" + segment)
            if node is None:
                break
        if best:
            return best
    return None


def split_url(df: DataFrame, url: str) -> DataFrame:
    """Add host and path: host, with A-Z in lower case, after the first "://" up to "/", "?", "#" or the end; then the path up to "?" or "#"."""
    rest = F.when(F.instr(F.col(url), "://") > 0, F.expr(f"substr(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return df.withColumns({"host": F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "path": path})


def judge(pages: DataFrame, rules: list[Rule], *, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """Verdict of every url: that of the longest rule that fits its host (or a parent domain) and begins its path.

    Returns (key, host, path, rule, verdict).  A null url, or one without "://", has an empty host and path;
    where no rule fits, rule is null and the verdict is ``default``.  Rows without a key and repeated rows are each judged; a url of any length
    is read whole; an empty table gives an empty result; further columns are ignored.
    """
    bad = [r for r in rules if r[2] not in ("allow", "block")]
    if bad:
        raise ValueError(f"a verdict is allow or block: {bad[0]}")
    spark = pages.sparkSession
    out = split_url(pages.select(F.col(key), F.col(url).alias("url")), "url").select(key, "host", "path")
    out = out.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string")})
    for i in range(0, max(1, len(rules)), MAX_BROADCAST_RULES):
        shipped = spark.sparkContext.broadcast(build_trie(rules[i : i + MAX_BROADCAST_RULES]))

        def match(batches: Iterator[pd.DataFrame], shipped=shipped) -> Iterator[pd.DataFrame]:
            trie = shipped.value
            for pdf in batches:
                rule, verdict = list(pdf["rule"]), list(pdf["verdict"])
                for k, (host, path) in enumerate(zip(pdf["host"], pdf["path"])):
                    found = longest_match(trie, host, path)
                    if found and (rule[k] is None or rank(*found) > rank(rule[k], verdict[k])):
                        rule[k], verdict[k] = found
                yield pdf.assign(rule=pd.Series(rule, index=pdf.index, dtype=object), verdict=pd.Series(verdict, index=pdf.index, dtype=object))

        out = out.mapInPandas(match, out.schema)
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def rank(rule: str, verdict: str) -> tuple[int, int, bool]:
    """Precedence of a rule that fits: host labels, then length, then block."""
    return rule.split("/", 1)[0].count("."), len(rule), verdict == "block"
