"""URL rules by a sort-merge range join: reversed hosts make a rule's hosts an interval, a sorted sweep does the rest."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.text import ascii_lower, text_of

#: (host, path, verdict): the rules of the registered query.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: Rules are swept in blocks of so many, which bounds what each task holds; every url meets every block.
BLOCK = 200_000


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(text_of(url), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(text_of(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


#: What stands for the characters of a host that keys need for themselves, in this order; any pairs without a dot serve.
ESCAPES = [("\1", "\1\2"), ("\0", "\1\1")]


def host_key(host: str) -> str:
    """Labels from the last to the first, each ended by a character below all others: subdomains follow as one run."""
    for plain, escaped in ESCAPES:
        host = host.replace(plain, escaped)
    return "\0".join(reversed(host.split("."))) + "\0"


def host_key_of(host: Column) -> Column:
    """host_key() of a column."""
    for plain, escaped in ESCAPES:
        host = F.replace(host, F.lit(plain), F.lit(escaped))
    return F.concat(F.array_join(F.reverse(F.split(host, "[.]", -1)), "\0"), F.lit("\0"))


def rank(rule: str) -> tuple[int, int]:
    return len(rule), rule.find("/")


def sweep(rules: list[tuple[str, str, str]]):
    """A function for mapInPandas over rows sorted by key: the longest rule that fits each url, or null."""
    starts = sorted((host_key(h), h, p, v) for h, p, v in rules)
    keys = [s[0] for s in starts]

    def active_at(key: str) -> list[tuple[str, str, str, str]]:
        """The rules whose interval is open just before key: those of its own ancestors."""
        held, end = [], key.find("\0")
        while end >= 0:
            prefix = key[: end + 1]
            i = bisect_right(keys, prefix) - 1
            while i >= 0 and keys[i] == prefix:
                held.append(starts[i])
                i -= 1
            end = key.find("\0", end + 1)
        return sorted(held)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stack: list | None = None
        at, last, fits = 0, None, []
        for f in frames:
            found, verdicts = [], []
            for key, path in zip(f["key"], f["path"], strict=True):
                if key != last:
                    if stack is None:  # where the sorted run of this task begins
                        stack, at = active_at(key), bisect_right(keys, key)
                    while at < len(starts) and keys[at] <= key:
                        while stack and not keys[at].startswith(stack[-1][0]):
                            stack.pop()
                        stack.append(starts[at])
                        at += 1
                    while stack and not key.startswith(stack[-1][0]):
                        stack.pop()
                    last, fits = key, sorted(stack, key=lambda s: (-len(s[1]) - len(s[2]), -len(s[1]), s[2]))
                rule = next((s for s in fits if path.startswith(s[2])), None)
                found.append(rule and rule[1] + rule[2])
                verdicts.append(rule and rule[3])
            out = f.assign(rule=pd.Series(found, dtype=object, index=f.index), verdict=pd.Series(verdicts, dtype=object, index=f.index))
            if "rule" in f:  # what earlier blocks of rules found stays where it is longer
                stays = [r is not None and (n is None or rank(r) >= rank(n)) for r, n in zip(f["rule"], found, strict=True)]
                out.loc[stays, ["rule", "verdict"]] = f.loc[stays, ["rule", "verdict"]]
            yield out

    return run


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of every row of pages.

    Of the rules whose host the url's host equals or ends with (after a dot) and whose path starts the url's path, the
    longest as text wins, ties to the longer host. No rule: rule is null and verdict the default. A null url or one
    without :// has an empty host and path. Null page_ids and repeated rows pass through; other columns take no part;
    an empty table gives an empty table. Hosts may hold any character. Hot hosts are split by path and page_id, as a range
    may end inside a host. The rules are a list that the caller holds; tasks get BLOCK of them at a time.
    """
    host = host_of(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path_of(F.col("url")).alias("path"))
    urls = urls.withColumn("key", host_key_of(F.col("host")))
    ordered = ["key", "path", "page_id"]
    urls = urls.repartitionByRange(*ordered).sortWithinPartitions(*ordered)
    schema = "page_id long, host string, path string, key string, rule string, verdict string"
    for at in range(0, max(len(rules), 1), BLOCK):  # rows stay where they are, in their order
        urls = urls.mapInPandas(sweep(rules[at : at + BLOCK]), schema)
    verdict = F.coalesce("verdict", F.lit(default))
    return urls.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def op5_url_rules(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), RULES)


OP5_SQL = r"""
with r(host, path, verdict) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u as (select page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') as path from pages),
m as (select u.page_id, u.host, u.path, arg_max(r.host || r.path, length(r.host || r.path)) as rule,
        arg_max(r.verdict, length(r.host || r.path)) as verdict
      from u left join r on (u.host = r.host or ends_with(u.host, '.' || r.host)) and starts_with(u.path, r.path)
      group by all)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from m
"""
