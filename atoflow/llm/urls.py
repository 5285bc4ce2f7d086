"""URL filters: a blocked Bloom filter of listed canonical URLs in front of an exact hash join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A block is one 64-byte cache line of 512 bits; a key sets PROBES bits of its block.
BLOCK_BITS, PROBES = 512, 8
#: Bits per listed key, and the largest filter that is sent to every task; a longer list fills it
#: more, which only sends more keys to the exact join.
BITS_PER_KEY, MAX_BLOCKS = 16, 1 << 18


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), up, low)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; without ``://`` empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without ``www.``, path without a closing slash or an ``index`` page's name; null if there is no host."""
    path = F.regexp_replace(path, r"(/index\.html?)?/?$", "")
    return F.when(host != "", F.concat(F.regexp_replace(host, r"^www\.", ""), path))


def bloom_blocks(keys: int) -> int:
    """Blocks for so many keys: a power of two up to ``MAX_BLOCKS`` (16 MB)."""
    return min(MAX_BLOCKS, 1 << max(0, -(-keys * BITS_PER_KEY // BLOCK_BITS) - 1).bit_length())


def _probe(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """Block number of a key and its bit numbers in the block."""
    h, g = F.xxhash64(F.lit(1), key), F.xxhash64(F.lit(2), key)
    return F.pmod(h, F.lit(blocks)), [F.shiftrightunsigned(g, 7 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)) for i in range(PROBES)]


def bloom_filter(listed: DataFrame, key: str = "key") -> tuple[np.ndarray, int]:
    """Words of the blocked Bloom filter (8 longs a block) and its number of blocks.

    Bits are combined per word in the tasks; at most 8 * ``MAX_BLOCKS`` rows reach the driver.
    """
    blocks = bloom_blocks(listed.count())
    block, bits = _probe(F.col(key), blocks)
    each = listed.select(block.alias("block"), F.explode(F.array(*bits)).alias("bit"))
    each = each.select((F.col("block") * 8 + F.shiftright("bit", 6)).alias("word"),
                       F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("mask"))
    out = np.zeros(blocks * 8, np.int64)
    for r in each.groupBy("word").agg(F.bit_or("mask").alias("mask")).collect():
        out[r.word] = r["mask"]
    return out, blocks


def possible(rows: DataFrame, key: str, words: np.ndarray, blocks: int) -> DataFrame:
    """The rows whose key may be listed: all its bits are set in its block.  Null keys never are."""
    sent = rows.sparkSession.sparkContext.broadcast(words)
    names, schema = rows.columns, rows.schema
    block, bits = _probe(F.col(key), blocks)
    probed = rows.filter(F.col(key).isNotNull()).select("*", block.alias("__block"), F.array(*bits).alias("__bits"))

    def run(batches):
        w = sent.value.view(np.uint64)
        for b in batches:
            base = b.column("__block").to_numpy().astype(np.int64) * 8
            bit = b.column("__bits").flatten().to_numpy().reshape(-1, PROBES).astype(np.int64)
            hit = ((w[base[:, None] + (bit >> 6)] >> (bit & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)
            yield pa.RecordBatch.from_arrays(b.columns[:-2], names=names).filter(pa.array(hit))

    return probed.mapInArrow(run, schema)


def listed_keys(keys: DataFrame, listed: DataFrame, key: str = "key") -> DataFrame:
    """The rows of ``keys`` whose key is listed, with the list's columns: Bloom filter, then exact join.

    ``listed`` has one row per key.  Distinct possible hits only are joined, so a key that a third
    of the rows share is one row of the join.
    """
    listed = listed.filter(F.col(key).isNotNull())
    words, blocks = bloom_filter(listed, key)
    maybe = possible(keys.select(key).distinct(), key, words, blocks)
    return maybe.join(listed, key)


def rule_keys(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """Keys of all rules that may fit: each domain the host lies in, with each start of the path of a listed length."""
    parts = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws(
        ".", F.slice(parts, i, F.size(parts))))
    starts = F.array(*(F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in path_lengths))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(F.array_compact(starts), lambda p: F.concat(s, p))))


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule, verdict, listed.

    ``rules(key, verdict)``: host and start of path in one text, such as ``example.org/es/``; a rule
    fits its host and all subdomains.  The longest fitting rule decides; without one a page is
    blocked if its canonical URL is in ``listed(key)``, else allowed.  Rules and listed URLs go
    through one Bloom filter and one exact join.  Null urls and urls without ``://`` have empty
    host and path, fit nothing and are allowed.  Rows repeat as often as in the input; other
    columns are not read.

    Pages are reduced to their distinct (host, path) before anything is shuffled to a join, and
    come back by it; few path lengths occur among rules, so a page has few keys.
    """
    rules = rules.filter("key is not null").groupBy("key").agg(F.min("verdict").alias("verdict"))
    lengths = sorted(r[0] for r in rules.select(
        F.length("key") - F.instr("key", "/") + 1).distinct().collect())  # as many as rules have path lengths
    table = rules.select("key", "verdict", F.lit(True).alias("is_rule")).unionByName(
        listed.select("key").filter("key is not null").distinct().select(
            F.concat(F.lit("="), "key").alias("key"), F.lit("block").alias("verdict"), F.lit(False).alias("is_rule")))
    split = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    places = split.select("host", "path").distinct()
    keys = places.select("host", "path", F.explode(F.concat(
        F.when(F.col("host") != "", rule_keys(F.col("host"), F.col("path"), lengths)).otherwise(F.array().cast("array<string>")),
        F.array_compact(F.array(F.concat(F.lit("="), canonical(F.col("host"), F.col("path"))))))).alias("key"))
    hits = keys.join(listed_keys(keys, table), "key")
    best = hits.groupBy("host", "path").agg(
        F.max(F.when(F.col("is_rule"), F.struct(F.length("key").alias("n"), "key", "verdict"))).alias("r"),
        F.max(~F.col("is_rule")).alias("listed"))
    best = best.select(F.col("host").alias("h"), F.col("path").alias("p"), "r", "listed")
    out = split.join(best, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left")
    return out.select(
        F.col("id").alias(id_col), "host", "path", F.col("r.key").alias("rule"),
        F.coalesce("r.verdict", F.when(F.col("listed"), F.lit("block")), F.lit("allow")).alias("verdict"),
        F.coalesce("listed", F.lit(False)).alias("listed"))
