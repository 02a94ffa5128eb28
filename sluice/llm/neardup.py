"""SimHash near-duplicates by pigeonring filtering.

The 64 bits form a ring of four 16-bit segments.  If two fingerprints differ in
at most three bits, some segment starts a chain whose first 1, 2, 3 and 4
segments differ in at most 0, 1, 2 and 3 bits in all: the budget 3 shared out in
proportion.  Chains of length two are enumerated as keys (first segment as it
is, second within one bit), so equal keys are the only candidates; the rest of
the chain is checked before the full Hamming distance.  A key that too many
fingerprints share is dealt out again by chains of three, then of four segments.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, release, shuffle_partitions, small_batches
from .components import components
from .simhash import shingle_fingerprints, vote_arrays

RADIUS, SEGMENTS, BITS = 3, 4, 16
#: Fingerprints under one key that are compared at once; a key with more goes on to
#: longer chains.  Keys of four segments hold 43,745 fingerprints at most, since each
#: is the key's bits and at most three more.
SPLIT_OVER = 512


def cleared(segment: np.ndarray, most: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """(index, variant): each 16-bit segment with every choice of at most ``most`` of its 1-bits cleared.

    Two segments d bits apart meet at their common bits, d cleared at most.
    """
    at, out = [], []
    for n in range(RADIUS + 1):
        may = np.flatnonzero(np.broadcast_to(n <= np.asarray(most), segment.shape))
        if not len(may):
            break
        for bits in combinations(range(BITS), n):
            mask = np.uint64(sum(1 << b for b in bits))
            own = may[(segment[may] & mask) == mask]
            at.append(own)
            out.append(segment[own] ^ mask)
    return np.concatenate(at), np.concatenate(out)


def segment_of(fp: np.ndarray, i) -> np.ndarray:
    return (fp >> ((np.asarray(i) % SEGMENTS) * BITS).astype(np.uint64)) & np.uint64(0xFFFF)


def chain_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row index, key) for the chains of two segments of uint64 fingerprints: start, its segment, a variant of the next."""
    rows, keys = [], []
    for i in range(SEGMENTS):
        at, two = cleared(segment_of(fp, i + 1), 1)
        rows.append(at)
        keys.append(np.uint64(i) << np.uint64(32) | segment_of(fp, i)[at] << np.uint64(16) | two)
    return np.concatenate(rows), np.concatenate(keys)


def longer_chains(key: np.ndarray, rest: np.ndarray, fp: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(row index, rest of the key) of the chains with one segment more, of ``length`` in all.

    All variants of a chain share its budget: what the third segment has cleared the fourth may not.
    """
    start = (key >> np.uint64(32) & np.uint64(3)).astype(np.int64)
    own = segment_of(fp, start + length - 1)
    most = np.full(len(fp), 2) if length == 3 else RADIUS - np.bitwise_count(rest ^ segment_of(fp, start + 2)).astype(np.int64)
    at, variant = cleared(own, most)
    return at, rest[at] << np.uint64(16) | variant


def chain_holds(apart: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Does the chain from ``start`` keep its proportional budgets?"""
    total, ok = np.zeros(len(apart), np.int64), np.ones(len(apart), bool)
    for length in range(1, SEGMENTS + 1):
        total = total + np.bitwise_count(segment_of(apart, start + length - 1))
        ok &= total <= length * RADIUS // SEGMENTS
    return ok


def flood(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of ``n`` nodes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def find_links(group: np.ndarray, start: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star links (fp, root) that join what is within RADIUS in each group of sorted rows."""
    size = np.bincount(group)
    a, b = [], []
    live = np.flatnonzero(size[group] > 1)
    for s in range(1, int(size.max(initial=1))):
        live = live[live + s < len(group)]
        live = live[group[live] == group[live + s]]
        if not len(live):
            break
        apart = fps[live] ^ fps[live + s]
        ok = np.flatnonzero(chain_holds(apart, start[live]))
        a.append(fps[live[ok]])
        b.append(fps[live[ok] + s])
    if not a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    a, b = np.concatenate(a), np.concatenate(b)
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = flood(len(nodes), flat[: len(a)], flat[len(a) :])
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


_KEYED = "key long, rest long, fp long"


def _expand(batches):
    for b in batches:
        fp = b["fp"].to_numpy(np.int64).astype(np.uint64)
        seed = b["seed"].to_numpy(np.int64)
        for i in range(0, len(fp), 20_000):
            part = fp[i : i + 20_000]
            rows, keys = chain_keys(part)
            keys = keys.astype(np.int64) | seed[i : i + 20_000][rows] << 40
            yield pd.DataFrame({"key": keys, "rest": 0, "fp": part[rows].astype(np.int64)})


def _expand_further(length: int):
    def run(batches):
        for b in batches:
            for i in range(0, len(b), 20_000):
                key, rest, fp = (b[c].to_numpy(np.int64)[i : i + 20_000].astype(np.uint64) for c in ("key", "rest", "fp"))
                at, more = longer_chains(key, rest, fp, length)
                yield pd.DataFrame({"key": key[at].astype(np.int64), "rest": more.astype(np.int64), "fp": fp[at].astype(np.int64)})
        release()

    return run


def _link(length: int, most: int):
    """Links of sorted (key, rest, fp) rows; rows of keys that more than ``most`` share come out as they are."""
    last_chain = length == SEGMENTS

    def run(batches):
        names = ("key", "rest", "fp")
        held = {c: np.zeros(0, np.int64) for c in names}
        hot = None

        def rows_of(x, at):
            return pd.DataFrame({"seed": x["key"][at] >> 40, "a": x["fp"][at], "b": 0, "key": x["key"][at], "rest": x["rest"][at], "open": True})

        def settle(x):
            new = np.r_[True, (x["key"][1:] != x["key"][:-1]) | (x["rest"][1:] != x["rest"][:-1])]
            group = np.cumsum(new) - 1
            large = np.bincount(group)[group] > most if not last_chain else np.zeros(len(group), bool)
            if large.any():
                yield rows_of(x, large)
            small = np.flatnonzero(~large)
            seeds = x["key"][small] >> 40
            for s in np.unique(seeds):
                own = small[slice(*np.searchsorted(seeds, [s, s + 1]))]
                key, fp = x["key"][own].astype(np.uint64), x["fp"][own].astype(np.uint64)
                _, dense = np.unique(group[own], return_inverse=True)
                a, b = find_links(dense, (key >> np.uint64(32) & np.uint64(3)).astype(np.int64), fp)
                if len(a):
                    yield pd.DataFrame({"seed": s, "a": a.astype(np.int64), "b": b.astype(np.int64), "key": 0, "rest": 0, "open": False})

        for batch in batches:
            x = {c: np.concatenate([held[c], batch[c].to_numpy(np.int64)]) for c in names}
            if hot is not None:
                on = (x["key"] == hot[0]) & (x["rest"] == hot[1])
                if on.any():
                    yield rows_of(x, on)
                    x = {c: v[~on] for c, v in x.items()}
            if not len(x["key"]):
                continue
            # The last key may go on in the next batch; once it is too common its rows pass through.
            tail = (x["key"] == x["key"][-1]) & (x["rest"] == x["rest"][-1])
            if not tail.all():
                yield from settle({c: v[~tail] for c, v in x.items()})
            held = {c: v[tail] for c, v in x.items()}
            if not last_chain and len(held["key"]) > most:
                hot = (held["key"][0], held["rest"][0])
                yield rows_of(held, slice(None))
                held = {c: np.zeros(0, np.int64) for c in names}
        if len(held["key"]):
            yield from settle(held)
        release()

    return run


def links_within(fps: DataFrame, split_over: int = SPLIT_OVER) -> DataFrame:
    """Links (seed, a, b) that join the distinct (seed, fp) of a seed exactly as all pairs within RADIUS would."""
    n = shuffle_partitions(fps.sparkSession)
    keyed, found = fps.select("seed", "fp").mapInPandas(_expand, _KEYED), []
    for length in range(2, SEGMENTS + 1):
        dealt = keyed.repartition(n, "key", "rest").sortWithinPartitions("key", "rest")
        out = materialise(dealt.mapInPandas(_link(length, split_over), "seed long, a long, b long, key long, rest long, open boolean"), "near")
        found.append(out.where("not open").select("seed", "a", "b"))
        left = out.where("open")
        if length == SEGMENTS or left.isEmpty():
            break
        keyed = left.select("key", "rest", F.col("a").alias("fp")).mapInPandas(_expand_further(length + 1), _KEYED)
    return star(reduce(DataFrame.unionByName, found), "seed")


def star(links: DataFrame, *within: str) -> DataFrame:
    """Links (a, b) with the same components and about one of each a.

    An a has few links, for it has few keys: they all go to the least of its ends, and so does the a.
    """
    ends = F.transform(F.concat(F.array("a"), "bs"), lambda x: F.struct(x.alias("a"), F.array_min("bs").alias("b")))
    near = links.groupBy(*within, "a").agg(F.collect_set("b").alias("bs"))
    return near.select(*within, F.explode(ends).alias("e")).select(*within, "e.*").where("a <> b").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row of ``docs``: its ``carry`` columns (doc_id among them), fp (long) and component_id.

    component_id is the smallest doc_id of the component, null where all of
    its ids are null.  Documents without words share the fingerprint 0 and link
    like any other.  Exact copies fold into one fingerprint before anything is
    compared.  An empty table gives no rows.
    """
    marked = materialise(shingle_fingerprints(docs, list(carry), shingle), "fingerprints")
    distinct = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("seed", F.lit(0)), "distinct")
    roots = components(links_within(distinct), "a", "b")
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = named.join(lowest, "root").select("fp", "component_id")
    return marked.join(ids, "fp").select(*carry, "fp", "component_id")


#: Independent word-set fingerprints of a text when groups of near copies are sought.
SEEDS = 6
#: Minima of a text's shingles, in BANDS bands of ROWS: two texts of similarity J share
#: no band with probability (1 - J**ROWS)**BANDS, 5e-8 at J = 0.8.
BANDS, ROWS = 32, 4
#: What makes a near copy: Jaccard similarity of the sets of five-word shingles.
SHINGLE, SIMILARITY = 5, 0.8
#: Shingles that one task holds of one candidate group; larger groups are led by as many.
CHUNK_SHINGLES = 400_000


class _Group:
    """Shingle sets side by side: how much each shares with a given one."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        self.start = np.cumsum(self.size) - self.size
        _, self.code = np.unique(np.concatenate(sets), return_inverse=True)
        self.flag = np.zeros(int(self.code.max()) + 1, np.int64)

    def alike(self, i: int) -> np.ndarray:
        own = self.code[self.start[i] : self.start[i] + self.size[i]]
        self.flag[own] = 1
        shared = np.add.reduceat(self.flag[self.code], self.start)
        self.flag[own] = 0
        return shared * 1.0 >= SIMILARITY * (self.size + self.size[i] - shared)


def _drop_followers(g: pd.DataFrame) -> np.ndarray:
    """Rows (by ascending id) that are like an earlier row that stays."""
    group, gone = _Group(g["sh"].tolist()), np.zeros(len(g), bool)
    for i in range(len(g)):
        if not gone[i]:
            hit = group.alike(i)
            hit[: i + 1] = False
            gone |= hit
    return gone


def _drop_led(g: pd.DataFrame) -> np.ndarray:
    """Rows that are like a leader; leaders come first and stay."""
    group, gone = _Group(g["sh"].tolist()), np.zeros(len(g), bool)
    leaders = int(g["own"].sum())
    for i in range(leaders):
        gone |= group.alike(i)
    gone[:leaders] = False
    return gone


def _dropped(solve):
    """The keys that ``solve`` drops of a group."""
    return lambda g: pd.DataFrame({"key": g["key"].to_numpy()[solve(g)]})


def _by_group(solve):
    """Run ``solve`` on each (root, part) of sorted rows."""

    def run(batches):
        held = None

        def out(df):
            cut = np.flatnonzero(np.r_[True, (df["root"].to_numpy()[1:] != df["root"].to_numpy()[:-1]) | (df["part"].to_numpy()[1:] != df["part"].to_numpy()[:-1])])
            for s, e in zip(cut, np.r_[cut[1:], len(df)]):
                if e - s > 1:
                    made = solve(df.iloc[s:e])
                    if len(made):
                        yield made

        for b in batches:
            held = b if held is None else pd.concat([held, b], ignore_index=True)
            if not len(held):
                continue
            last = held.iloc[-1]
            whole = ~((held["root"] == last["root"]) & (held["part"] == last["part"])).to_numpy()
            if whole.any():
                yield from out(held[whole])
                held = held[~whole].reset_index(drop=True)
        if held is not None and len(held):
            yield from out(held)
        release()

    return run


def _solved(parts: DataFrame, solve, schema: str = "key string") -> DataFrame:
    n = shuffle_partitions(parts.sparkSession)
    dealt = parts.repartition(n, "root", "part").sortWithinPartitions("root", "part", "id", "key")
    return dealt.mapInPandas(_by_group(solve), schema).distinct()


def first_come(links: DataFrame) -> DataFrame:
    """Keys that go when each goes that is linked to an earlier one that stays.

    ``links``: key, later (key), each pair once and the earlier first.
    """
    gone, now = None, materialise(links, "alike")
    while True:
        # Without an earlier partner a key stays; what is linked to it goes, with all its links.
        stay = now.select("key").distinct().join(now.select(F.col("later").alias("key")), "key", "left_anti")
        lost = materialise(now.join(stay, "key").select(F.col("later").alias("key")).distinct(), "copies")
        gone = lost if gone is None else gone.unionByName(lost)
        out = lost.withColumnRenamed("key", "later")
        then = materialise(now.join(lost, "key", "left_anti").join(out, "later", "left_anti").select("key", "later"), "alike")
        discard(now)
        now = then
        if now.isEmpty():
            return gone


def near_copies(texts: DataFrame, chunk: int = CHUNK_SHINGLES) -> DataFrame:
    """Keys that go: each is at least SIMILARITY like a text of its group that stays and has a smaller (id, key).

    ``texts``: root (candidate group), id, key, sh (distinct shingle hashes).
    A group within ``chunk`` shingles is settled by one task.  Of a larger one
    the first ``chunk`` shingles by (id, key) are; those that stay lead, and what
    is like a leader goes.  The rest begins anew until a round drops less than a
    tenth of it; then ``like_pairs`` finds the like pairs that are left, and ``first_come``
    settles them.  So a group's size never changes the result.
    """
    left, gone = texts, None
    while True:
        sizes = left.groupBy("root").agg(F.ceil(F.sum(F.size("sh")) / chunk).cast("int").alias("parts"), F.count("*").alias("n"))
        many = left.join(sizes.where("n > 1").select("root", "parts"), "root")
        large = many.where("parts > 1")
        before = Window.partitionBy("root").orderBy("id", "key").rowsBetween(Window.unboundedPreceding, -1)
        ahead = large.select("root", "id", "key", F.size("sh").alias("n")).withColumn("_at", F.coalesce(F.sum("n").over(before), F.lit(0)))
        first = materialise(ahead.where(F.col("_at") < chunk).select("root", "key"), "first")
        head = many.where("parts = 1").unionByName(large.join(first, ["root", "key"], "left_semi"))
        lost = materialise(_solved(head.select("root", F.lit(0).alias("part"), "id", "key", "sh"), _dropped(_drop_followers)), "copies")
        gone = lost if gone is None else gone.unionByName(lost)
        if first.isEmpty():
            return gone.distinct()
        rest = materialise(large.join(first, ["root", "key"], "left_anti"), "left")
        leads = large.join(first, ["root", "key"], "left_semi").join(lost, "key", "left_anti")
        part = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
        both = rest.withColumn("part", part).withColumn("own", F.lit(0)).unionByName(
            leads.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("own", F.lit(1))
        )
        lost = materialise(_solved(both.select("root", "part", "own", "id", "key", "sh"), _dropped(_drop_led)), "copies")
        gone = gone.unionByName(lost)
        left = materialise(rest.join(lost, "key", "left_anti").select("root", "id", "key", "sh"), "left")
        after = left.count()
        if not after:
            return gone.distinct()
        if after > 0.9 * rest.count():
            break
    alike = materialise(like_pairs(left), "pairs")
    return gone.unionByName(first_come(alike)).distinct()


def meeting(texts: DataFrame) -> DataFrame:
    """(root, key, later): pairs of a group's texts that may be SIMILARITY like, each once, the one of smaller (id, key) first.

    By prefixes: of its shingles, rarest in the group first, a text shares one of the first
    n - ceil(SIMILARITY n) + 1 with every text that is like it.  Texts meet by those shingles alone, so
    the work follows the pairs that share rare shingles, not the group's size squared.
    """
    each = texts.select("root", "id", "key", F.size("sh").alias("n"), F.explode("sh").alias("t"))
    common = each.groupBy("root", "t").agg(F.count("*").alias("c"))
    ranked = each.join(common, ["root", "t"]).groupBy("root", "id", "key", "n").agg(F.sort_array(F.collect_list(F.struct("c", "t"))).alias("ts"))
    # A thousandth of a shingle less than the bound, as the bound is not exact in binary.
    needed = F.ceil(F.col("n") * SIMILARITY - 1e-3)
    rare = F.filter(F.slice("ts", 1, (F.col("n") - needed + 1).cast("int")), lambda x: x["c"] > 1)
    first = materialise(ranked.select("root", F.struct("id", "key").alias("at"), "n", F.explode(rare).alias("x")).select("root", "at", "n", "x.t"), "prefixes")
    other = first.select("root", "t", F.col("at").alias("at2"), F.col("n").alias("n2"))
    near = (F.col("n2") >= F.col("n") * SIMILARITY - 1e-3) & (F.col("n") >= F.col("n2") * SIMILARITY - 1e-3)
    met = first.join(other, ["root", "t"]).where((F.col("at") < F.col("at2")) & near)
    return met.select("root", F.col("at.key").alias("key"), F.col("at2.key").alias("later")).distinct()


def like_pairs(texts: DataFrame) -> DataFrame:
    """The pairs (key, later) of ``meeting`` that are at least SIMILARITY like: none of the group's like pairs is missed.

    ``texts``: root, id, key, sh.
    """
    bag = lambda k, s: texts.select("root", F.col("key").alias(k), F.col("sh").alias(s))
    sets = meeting(texts).join(bag("key", "a"), ["root", "key"]).join(bag("later", "b"), ["root", "later"])
    shared = sets.withColumn("shared", F.size(F.array_intersect("a", "b")))
    held = shared.where(F.col("shared") * 1.0 >= SIMILARITY * (F.size("a") + F.size("b") - F.col("shared")))
    return held.select("key", "later").distinct()


def band_keys(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(set, band) keys of the non-empty sets of uint64 hashes that begin at ``starts``.

    An odd factor permutes the hashes; the least of each permutation is the same
    for two sets with the probability of their Jaccard similarity.
    """
    factors = np.random.default_rng(20).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
    keys, turned = np.empty((len(starts), BANDS), np.uint64), np.empty_like(values)
    for band in range(BANDS):
        key = np.full(len(starts), band, np.uint64)
        for f in factors[band * ROWS : (band + 1) * ROWS]:
            np.multiply(values, f, out=turned)
            key = (key ^ np.minimum.reduceat(turned, starts)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        keys[:, band] = key
    return keys


def _chain_bands(batches):
    """Links of each key to the first one of its band, of sorted rows."""
    band = first = None
    for b in batches:
        if not len(b):
            continue
        bands, keys = b["band"].to_numpy(), b["key"].to_numpy()
        new = np.r_[band is None or bands[0] != band, bands[1:] != bands[:-1]]
        # What goes on from the batch before keeps its first key.
        heads = np.flatnonzero(new)
        root = np.concatenate([np.full(heads[0] if len(heads) else len(keys), first if first is not None else 0), np.repeat(keys[heads], np.diff(np.r_[heads, len(keys)]))])
        band, first = bands[-1], root[-1]
        apart = keys != root
        if apart.any():
            yield pd.DataFrame({"a": keys[apart], "b": root[apart]})
    release()


# --- texts as hashes ----------------------------------------------------------

_BYTES = np.arange(256)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_GAP = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
#: Bytes of a word that are hashed position by position for all words at once; longer words one by one.
_SHORT_WORD = 40
_ODD = np.random.default_rng(5).integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def word_hashes(data: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every word of the texts ``data[edge[i]:edge[i + 1]]``, A-Z lower-cased, in order."""
    low = _LOWER[data]
    solid = ~_GAP[data]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    inner = edge[(edge > 0) & (edge < len(data))]
    begins[inner] = solid[inner]
    ends[inner - 1] = solid[inner - 1]
    start = np.flatnonzero(begins)
    size = np.flatnonzero(ends) + 1 - start
    h = size.astype(np.uint64) * _ODD[0]
    order = np.argsort(-size, kind="stable")
    many = np.searchsorted(-size[order], -np.arange(1, _SHORT_WORD + 1), side="right")
    for j in range(_SHORT_WORD):
        # The words with more than j bytes.
        own = order[: many[j]]
        if not len(own):
            break
        h[own] = (h[own] ^ low[start[own] + j]) * _ODD[1 + j % 8]
        h[own] ^= h[own] >> np.uint64(29)
    if (size > _SHORT_WORD).any():
        import xxhash

        for i in np.flatnonzero(size > _SHORT_WORD):
            h[i] = xxhash.xxh64_intdigest(low[start[i] : start[i] + size[i]].tobytes(), 42)
    return mixed(h), np.searchsorted(edge, start, side="right") - 1


def shingle_runs(words: np.ndarray, text: np.ndarray, n_texts: int, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, edges): every run of ``size`` words of each text; of fewer words the whole sequence; of none a single 0."""
    count = np.bincount(text, minlength=n_texts)
    first = np.cumsum(count) - count
    runs = np.maximum(count - size + 1, 1)
    edge = np.r_[0, np.cumsum(runs)]
    own = np.repeat(np.arange(n_texts), runs)
    at = first[own] + np.arange(edge[-1]) - edge[own]
    out = np.zeros(edge[-1], np.uint64)
    for k in range(size):
        in_text = np.flatnonzero(k < count[own])
        out[in_text] += words[at[in_text] + k] * _ODD[16 + k]
    out = mixed(out)
    out[count[own] == 0] = 0
    return out, edge


def distinct_runs(values: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each run sorted and without repeats."""
    own = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
    order = np.lexsort((values, own))
    values, own = values[order], own[order]
    keep = np.r_[True, (values[1:] != values[:-1]) | (own[1:] != own[:-1])] if len(values) else np.zeros(0, bool)
    return values[keep], np.r_[0, np.cumsum(np.bincount(own[keep], minlength=len(edge) - 1))]


def _texts(batches, seen: set):
    """(rows, bytes, edges) of the texts that this task has not met, about a megabyte at a time."""
    for b in batches:
        keys, column = b.column("key").to_pylist(), b.column("text")
        rows = np.array([i for i, k in enumerate(keys) if not (k in seen or seen.add(k))], np.int64)
        sizes = np.asarray(pa.compute.binary_length(column))
        at = 0
        while at < len(rows):
            to = max(at + 1, at + int(np.searchsorted(np.cumsum(sizes[rows[at:]]), 1 << 20, side="right")))
            part = column.take(pa.array(rows[at:to]))
            offsets = np.frombuffer(part.buffers()[1], np.int32)[part.offset : part.offset + len(part) + 1].astype(np.int64)
            data = np.frombuffer(part.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
            yield b, rows[at:to], data, offsets - offsets[0]
            at = to


def _lists_of(values: np.ndarray, edge: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(np.ascontiguousarray(values).view(np.int64)))


def _sketches(seeds: int):
    """Per text: ``seeds`` fingerprints of its distinct words, and its BANDS keys of shingle minima."""

    def run(batches):
        for b, rows, data, edge in _texts(batches, set()):
            n = len(rows)
            h, text = word_hashes(data, edge)
            shingles, at = shingle_runs(h, text, n)
            bands = band_keys(shingles, at[:-1])
            bag, cut = distinct_runs(h, np.r_[0, np.cumsum(np.bincount(text, minlength=n))])
            fps = np.stack([vote_arrays(mixed(bag + _ODD[32 + s]), cut[:-1], cut[1:]) for s in range(seeds)], axis=1)
            every = lambda k: np.arange(n + 1) * k
            yield pa.RecordBatch.from_arrays(
                [b.column("short").take(pa.array(rows)), _lists_of(fps.ravel(), every(seeds)), _lists_of(bands.ravel(), every(BANDS))], names=["key", "fps", "bands"]
            )
        release()

    return run


def _first_met(batches):
    """Rows whose text this task has not met."""
    seen: set[str] = set()
    for b in batches:
        keys = b.column("key").to_pylist()
        rows = [i for i, k in enumerate(keys) if not (k in seen or seen.add(k))]
        yield b.take(pa.array(rows, pa.int64()))
    release()


def _shingle_rows(batches):
    """Distinct shingles per (root, id, key, text) row."""
    for b, rows, data, edge in _texts(batches, set()):
        h, text = word_hashes(data, edge)
        own, at = distinct_runs(*shingle_runs(h, text, len(rows)))
        keep = [b.column(c).take(pa.array(rows)) for c in ("root", "id", "key")]
        yield pa.RecordBatch.from_arrays([*keep, _lists_of(own, at)], names=["root", "id", "key", "sh"])
    release()


# --- one of each group ----------------------------------------------------------


def candidate_groups(docs: DataFrame, seeds: int) -> DataFrame:
    """(node, root) over ``short``: texts that some fingerprint puts within RADIUS or that share a band, transitively.

    ``docs``: key (digest of the text), short (60 bits of it), text.
    """
    made = materialise(docs.select("key", "short", "text").mapInArrow(_sketches(seeds), "key long, fps array<long>, bands array<long>"), "sketches")
    marked = made.select("key", F.posexplode("fps").alias("seed", "fp"))
    # A text stands for its copies, a fingerprint for its least text.
    per = materialise(marked.groupBy("seed", "fp").agg(F.min("key").alias("rep"), F.max("key").alias("other")), "distinct")
    shared = per.where("rep <> other").select("seed", "fp", "rep")
    same = marked.join(shared, ["seed", "fp"]).select(F.col("key").alias("a"), F.col("rep").alias("b")).where("a <> b").distinct()
    near = links_within(per)
    end = lambda name: per.select("seed", F.col("fp").alias(name), F.col("rep").alias(f"{name}_key"))
    across = near.join(end("a"), ["seed", "a"]).join(end("b"), ["seed", "b"]).select(F.col("a_key").alias("a"), F.col("b_key").alias("b"))
    banded = made.select(F.explode("bands").alias("band"), "key").repartition(shuffle_partitions(docs.sparkSession), "band").sortWithinPartitions("band", "key")
    alike = star(banded.mapInPandas(_chain_bands, "a long, b long"))
    roots = components(same.unionByName(across).unionByName(alike), "a", "b")
    discard(made, per)
    return roots


def one_per_group(docs: DataFrame, seeds: int = SEEDS) -> DataFrame:
    """``docs`` with one row left of each group of near copies: the smallest doc_id.

    Candidates are texts one of whose ``seeds`` fingerprints over their distinct
    words is within RADIUS bits of 64, or that share a band of shingle minima:
    fingerprints miss copies with words added.  Within such a group a text goes if its
    five-word shingles are at least SIMILARITY like those of a text with a
    smaller id that stays.  Of equal texts, and of repeated rows, one stays.  A null id is
    larger than any; a null text is empty; texts without words are alike.  An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    text, never = F.coalesce(F.col("text"), F.lit("")), F.lit((1 << 63) - 1)
    key, ident = F.md5(text), F.coalesce(F.col("doc_id").cast("long"), never)
    # Candidates go by 60 bits of the digest: texts that share them fall in one group, no more.
    short = lambda c: F.conv(F.substring(c, 1, 15), 16, 10).cast("long")
    slim = docs.select(key.alias("key"), short(key).alias("short"), text.alias("text"))
    copies = docs.select(key.alias("key"), ident.alias("id")).groupBy("key", "id").agg(F.count("*").alias("n"))
    least = materialise(copies.groupBy("key").agg(F.min(F.struct("id", "n")).alias("x")).select("key", "x.*"), "least")
    roots = candidate_groups(slim, seeds)
    members = roots.select(F.col("node").alias("short"), "root").unionByName(roots.select(F.col("root").alias("short"), "root").distinct())
    members = materialise(least.withColumn("short", short("key")).join(members, "short").select("key", "root", "id"), "members")
    bodies = slim.select("key", "text").mapInArrow(_first_met, "key string, text string").join(members, "key")
    sets = bodies.select("root", "id", "key", "text").mapInArrow(_shingle_rows, "root long, id long, key string, sh array<long>")
    texts = materialise(sets.groupBy("root", "key").agg(F.first("id").alias("id"), F.first("sh").alias("sh")), "shingles")
    gone = near_copies(texts)
    stay = materialise(least.join(gone, "key", "left_anti").select(F.col("id").alias("_id"), F.col("key").alias("_key"), "n"), "stay")
    discard(roots, members, texts, least)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), ident.alias("_id"), key.alias("_key"))
    kept = rows.join(stay, ["_id", "_key"])
    one = kept.where("n = 1").select("_row.*")
    if stay.where("n > 1").isEmpty():
        return one
    once = Window.partitionBy("_id", "_key").orderBy(F.lit(0))
    many = kept.where("n > 1").withColumn("_nth", F.row_number().over(once)).where("_nth = 1").select("_row.*")
    return one.unionByName(many)
