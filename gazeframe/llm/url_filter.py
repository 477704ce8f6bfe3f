"""URL filter: host and path rules, then a list of canonical URLs behind a blocked Bloom filter.

Everything is DataFrame functions. The filter has a fixed number of 512-bit blocks, so what is broadcast has a fixed
size; a page whose bits are all set goes to an exact hash join with the list, which removes the false positives.

Defined results: a URL that is null or has no ``://`` has empty host and path, fits no rule, is on no list and is
allowed. Repeated rows each get their own verdict. Extra columns of the input are ignored. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazeframe.llm.common import ascii_lower, written

#: Blocks of the Bloom filter: 2**15 blocks of 64 bytes are 2 MB, whatever the length of the list.
N_BLOCKS = 1 << 15
WORDS = 8


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), r"^([^/?#]*)([^?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^([^/?#]*)([^?#]*)", 2), F.lit(""))


def canonical(host_col: Column, path_col: Column) -> Column:
    """Host without ``www.`` or ``m.`` in front, path without ``.html`` and slashes at the end; null without a host."""
    bare = F.regexp_replace(host_col, r"^(www|m)\.", "")
    return F.when(host_col != "", F.concat(bare, F.regexp_replace(path_col, r"(\.html)?/*$", "")))


def fits(rule: str, host_col: Column, path_col: Column) -> Column:
    """True where the URL is on the rule's host or a subdomain of it, and its path starts with the rule's."""
    name, slash, tail = rule.partition("/")
    return ((host_col == name) | host_col.endswith("." + name)) & path_col.startswith(slash + tail)


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int")


def _bit(key: Column, word: int) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(key, F.lit(word)), F.lit(64)).cast("int"))


def bloom_blocks(listed: DataFrame, n_blocks: int = N_BLOCKS) -> DataFrame:
    """(block, w0..w7): at most ``n_blocks`` rows, one bit in each word for each listed URL."""
    bits = listed.select(_block(F.col("canon"), n_blocks).alias("block"), *[_bit(F.col("canon"), i).alias(f"w{i}") for i in range(WORDS)])
    return bits.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def judge(pages: DataFrame, rules: list[tuple[str, str]], listed: DataFrame, n_blocks: int = N_BLOCKS) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) for every row of ``pages`` (page_id, url).

    ``rules``: (``allow`` or ``block``, host and path). ``listed``: blocked URLs in column ``canon``, as ``canonical()`` makes them.
    """
    listed = written(listed.select("canon").where("canon is not null").distinct(), "listed")
    ranked = sorted(rules, key=lambda r: -len(r[1]))
    h, p = F.col("host"), F.col("path")
    none = F.lit(None).cast("string")
    rule = F.coalesce(*[F.when(fits(r, h, p), F.lit(r)) for _, r in ranked], none)
    by_rule = F.coalesce(*[F.when(F.col("rule") == r, F.lit(a)) for a, r in ranked], none)
    judged = (
        pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
        .withColumn("rule", rule)
        .withColumn("by_rule", by_rule)
        .withColumn("canon", canonical(h, p))
    )
    blocks = bloom_blocks(listed, n_blocks).withColumnRenamed("block", "at_block")
    hit = F.lit(True)
    for i in range(WORDS):
        bit = _bit(F.col("canon"), i)
        hit = hit & (F.col(f"w{i}").bitwiseAND(bit) == bit)
    probed = (
        judged.join(F.broadcast(blocks), _block(F.col("canon"), n_blocks) == F.col("at_block"), "left")
        .withColumn("possible", F.coalesce(F.col("canon").isNotNull() & hit, F.lit(False)))
    )
    keep = ["page_id", "host", "path", "rule", "by_rule"]
    clear = probed.where(~F.col("possible")).select(*keep, F.lit(False).alias("listed"))
    exact = listed.select(F.col("canon").alias("on_list"))
    checked = (
        probed.where("possible")
        .join(exact.hint("merge"), F.col("canon") == F.col("on_list"), "left")
        .select(*keep, F.col("on_list").isNotNull().alias("listed"))
    )
    verdict = F.coalesce("by_rule", F.when(F.col("listed"), "block").otherwise("allow"))
    return clear.unionByName(checked).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "listed")
