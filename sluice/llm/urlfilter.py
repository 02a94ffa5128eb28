"""URL filter: blocked Bloom filter of listed canonical URLs, then an exact join.

A listed URL is a host and the start of a path; it covers the host, all its
subdomains and every path with that start.  Each page URL yields the keys under
which it could be listed; the Bloom filter drops most of them and the exact
hash join removes the false positives.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits per listed URL, bits set per key, most filter bytes (beyond that the
#: filter has fewer bits a key: more false positives, the same result).
BITS_PER_KEY, PROBES, MAX_BYTES = 16, 8, 32 << 20
#: A list of at most this many characters in all is broadcast to the exact join.
BROADCAST_CHARS = 16 << 20


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    rest = _rest(url)
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.coalesce(F.position(F.lit("://"), url), F.lit(0))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def _hashes(keys: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(k.encode("utf-8", "surrogatepass"), 42) for k in keys), np.uint64, len(keys))


def _masks(h: np.ndarray) -> np.ndarray:
    """The bits of one 64-bit block that a key sets: six hash bits per probe."""
    mask, h = np.zeros(len(h), np.uint64), h * np.uint64(0x9E3779B97F4A7C15)
    for i in range(PROBES):
        mask |= np.uint64(1) << ((h >> np.uint64(6 * i + 4)) & np.uint64(63))
    return mask


class BlockedBloom:
    """Every key lives in one 64-bit block: a probe touches one word."""

    def __init__(self, n_keys: int):
        bits = min(max(64, n_keys * BITS_PER_KEY), MAX_BYTES * 8)
        self.words = np.zeros(-(-bits // 64), np.uint64)

    def _blocks(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(20)) % np.uint64(len(self.words))).astype(np.int64)

    def add(self, keys: list[str]) -> None:
        h = _hashes(keys)
        np.bitwise_or.at(self.words, self._blocks(h), _masks(h))

    def might_hold(self, keys: list[str]) -> np.ndarray:
        h = _hashes(keys)
        m = _masks(h)
        return (self.words[self._blocks(h)] & m) == m


def build_filter(listed: DataFrame) -> tuple[BlockedBloom, list[tuple[int, int]], int]:
    """The filter over ``listed`` (host, path), the (host labels, path length) pairs that occur, and the list's characters.

    Partial filters are made per partition and or-ed block by block; only
    filter words (MAX_BYTES at most) and distinct pairs reach the driver.
    """
    n, chars = listed.agg(F.count("*"), F.coalesce(F.sum(F.length("host") + F.length("path")), F.lit(0))).first()
    shape = BlockedBloom(n)

    def parts(batches):
        own = BlockedBloom(n)
        for b in batches:
            own.add([h + p for h, p in zip(b["host"], b["path"])])
        at = np.flatnonzero(own.words)
        yield pd.DataFrame({"block": at, "word": own.words[at].astype(np.int64)})

    rows = listed.select("host", "path").mapInPandas(parts, "block long, word long")
    got = rows.groupBy("block").agg(F.bit_or("word").alias("word")).toPandas()
    shape.words[got["block"].to_numpy(np.int64)] = got["word"].to_numpy(np.int64).astype(np.uint64)
    pairs = listed.select(F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("n")).distinct().collect()
    return shape, sorted((r.labels, r.n) for r in pairs), chars


def candidate_keys(host: str, path: str, shapes: list[tuple[int, int]]) -> list[str]:
    """Every key under which a URL could be listed: only host ends of as many labels as some listed host has.

    So a host of any length costs no more than the list's own shapes.
    """
    total, ends, out = host.count(".") + 1, {}, []
    for labels, n in shapes:
        if labels <= total and n <= len(path):
            if labels not in ends:
                ends[labels] = host if labels == total else ".".join(host.rsplit(".", labels)[1:])
            out.append(ends[labels] + path[:n])
    return out


def judge(pages: DataFrame, listed: DataFrame, url_col: str = "url") -> DataFrame:
    """Add host, path, rule and verdict to every row of ``pages``.

    ``listed``: host, path, verdict (``allow`` or ``block``), is_rule.  Of the
    rules that fit, the one with the longest host and path wins (of equal
    length, the longer host).  Where no rule fits, a listed URL blocks; what
    nothing covers is allowed.  A null URL or one without ``://`` has an empty
    host and path and no rule.  Repeated rows and extra columns stay; columns
    named host, path, rule or verdict are replaced.  Hosts and paths may be of
    any length.  An empty list allows all.

    Pages that share a host meet one row of the list.  A list of up to
    BROADCAST_CHARS characters is sent to every task; a longer one is joined by
    a shuffle, whose common keys adaptive execution splits.
    """
    bloom, shapes, chars = build_filter(listed)

    @F.pandas_udf("array<string>")
    def passing(host: pd.Series, path: pd.Series) -> pd.Series:
        keys = [candidate_keys(h, p, shapes) if h else [] for h, p in zip(host, path)]
        hit = bloom.might_hold([k for ks in keys for k in ks])
        out, at = [], 0
        for ks in keys:
            out.append([k for k, ok in zip(ks, hit[at : at + len(ks)]) if ok])
            at += len(ks)
        return pd.Series(out)

    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    rows = pages.select(
        F.monotonically_increasing_id().alias("_row"),
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_page"),
        host_of(F.col(url_col)).alias("host"),
        path_of(F.col(url_col)).alias("path"),
    )
    keyed = rows.withColumn("_key", F.explode_outer(passing("host", "path")))
    entries = listed.select(
        F.concat("host", "path").alias("_key"),
        F.struct(
            F.col("is_rule").alias("a"),
            (F.length("host") + F.length("path")).alias("b"),
            F.length("host").alias("c"),
            F.concat("host", "path").alias("entry"),
            F.col("verdict"),
        ).alias("_e"),
    ).groupBy("_key").agg(F.max("_e").alias("_e"))
    if chars <= BROADCAST_CHARS:
        entries = F.broadcast(entries)
    best = keyed.join(entries, "_key", "left").groupBy("_row").agg(
        F.first("_page").alias("_page"), F.first("host").alias("host"), F.first("path").alias("path"), F.max("_e").alias("_e")
    )
    return best.select(
        "_page.*",
        "host",
        "path",
        F.when(F.col("_e.a"), F.col("_e.entry")).alias("rule"),
        F.coalesce("_e.verdict", F.lit("allow")).alias("verdict"),
    )
