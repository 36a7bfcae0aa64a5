"""URL filters: rules by host and path, then a blocked Bloom filter before an exact hash join.

The filter of the listed canonical URLs is a table of blocks. A URL's hash picks one block and
eight bits inside it, one per 64-bit word, so a probe is one equi-join on the block number and
eight bit tests. The few URLs that pass go on to the exact join with the list, which removes the
false positives. Everything is DataFrame functions. Blocks and list are joined by key: Spark
broadcasts them while they are small and shuffles by block or URL otherwise.

Nulls: a null URL, or one without ``://``, has an empty host and path, fits no rule and is never
listed. Repeated URLs are judged alike. An empty list blocks nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.llm.common import Shielded

WORDS = 8
#: Listed URLs per block of 512 bits: 32 bits for each.
PER_BLOCK = 16


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _rest(url: Column) -> Column:
    """What follows the first ``://``, up to ``?`` or ``#``; null without one."""
    at = F.instr(url, "://")
    tail = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, F.substring_index(F.substring_index(tail, "?", 1), "#", 1))


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.substring_index(_rest(url), "/", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    rest = _rest(url)
    at = F.instr(rest, "/")
    return F.coalesce(F.when(at > 0, F.substring(rest, at, F.length(rest))), F.lit(""))


def canonical(url: Column) -> Column:
    """Host in lower case without ``www.`` and path without a closing slash; scheme, query and fragment do not count. Null without a host."""
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    return F.when(host != "", F.concat(host, F.regexp_replace(path_of(url), "/+$", "")))


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits the host or a domain above it and the start of the path."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def _block(url: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), url), blocks)


def _bit(url: Column, word: int) -> Column:
    """The bit of one word: six hash bits of its own."""
    six = F.shiftrightunsigned(F.xxhash64(url), 6 * word).bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), six)


def bloom_blocks(listed: DataFrame, url: str) -> DataFrame:
    """(block, blocks, w0..w7): the filter of distinct URLs, one row per block in use.

    Its size follows the list: 64 bytes for about ``PER_BLOCK`` URLs.
    """
    count = listed.agg(F.ceil(F.count(F.lit(1)) / PER_BLOCK).cast("long").alias("n")).select(F.greatest("n", F.lit(1)).alias("blocks"))
    sized = listed.withColumn("_blocks", count.scalar())
    return (
        sized.withColumn("_block", _block(F.col(url), F.col("_blocks")))
        .groupBy("_block", "_blocks")
        .agg(*[F.bit_or(_bit(F.col(url), i)).alias(f"_w{i}") for i in range(WORDS)])
    )


def listed_urls(urls: DataFrame, url: str = "url") -> DataFrame:
    """The distinct canonical forms."""
    return urls.select(canonical(F.col(url)).alias("_listed")).filter(F.col("_listed").isNotNull()).distinct()


def with_listed(pages: DataFrame, listed: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with ``_u_possible`` (passed the filter) and ``_u_listed`` (is in the list)."""
    filt = bloom_blocks(listed, "_listed")
    blocks = F.coalesce(filt.agg(F.max("_blocks")).scalar(), F.lit(1))
    probe = pages.withColumn("_canon", canonical(F.col(f"`{url}`"))).withColumn("_block", _block(F.col("_canon"), blocks))
    possible = F.lit(True)
    for i in range(WORDS):
        possible = possible & (F.col(f"_w{i}").bitwiseAND(_bit(F.col("_canon"), i)) != 0)
    passed = probe.join(filt.drop("_blocks"), "_block", "left").withColumn(
        "_u_possible", F.coalesce(possible & F.col("_canon").isNotNull(), F.lit(False))
    )
    # Only possible hits have a key that the list can hold; the others stay spread over the tasks.
    keyed = passed.withColumn("_key", F.when(F.col("_u_possible"), F.col("_canon")).otherwise(F.concat(F.lit("\u0000"), "_canon")))
    exact = keyed.join(listed.withColumnRenamed("_listed", "_key").withColumn("_hit", F.lit(True)), "_key", "left")
    return exact.withColumn("_u_listed", F.coalesce("_hit", F.lit(False))).drop(
        "_canon", "_block", "_key", "_hit", *[f"_w{i}" for i in range(WORDS)]
    )


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule], url: str = "url") -> DataFrame:
    """``pages`` with ``_u_host``, ``_u_path``, ``_u_rule``, ``_u_verdict`` and the two list columns."""
    shield = Shielded(pages)
    url = shield.of(url)
    u = F.col(url)
    seen = with_listed(shield.df, listed, url).withColumns({"_u_host": host_of(u), "_u_path": path_of(u)})
    name, verdict = matching_rule(F.col("_u_host"), F.col("_u_path"), rules)
    own = F.when(F.col("_u_listed"), F.lit("block")).otherwise(F.lit("allow"))
    return shield.back(seen.withColumns({"_u_rule": name, "_u_verdict": F.coalesce(verdict, own)}))
