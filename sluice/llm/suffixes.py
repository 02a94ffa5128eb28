"""Exact removal of repeated substrings by deep-shallow suffix sorting.

Every byte that a string of ``length`` bytes covers is removed if that string also
starts anywhere else in the corpus.

1. Partition.  The strings of a document are its suffixes cut to ``length``.
   Each belongs to its anchor: the position of the least k-gram hash inside it
   (the last of equals).  Equal strings have equal anchors at equal offsets, so
   suffixes need to be sorted among those of one anchor hash only.  Successive
   strings with one anchor form a block.
2. Prune.  An anchor hash seen once needs no sorting; if all blocks of a hash
   are the same (and more than one), all their strings are repeats.  Blocks are
   the same if two 64-bit hashes of their bytes agree.
3. Sort.  The suffixes of the distinct blocks of a hash are ordered by
   multikey quicksort on 8-byte symbols down to a shallow depth; groups that
   are still equal there are ordered by blind tries.  A leaf with two suffixes,
   or one whose block occurs twice, is a repeat.  Where a hash has too many
   blocks for a task, its strings are dealt out by their bytes and equal ones counted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _process_cache, materialise, release, shuffle_partitions, small_batches

LENGTH, GRAM = 200, 48
#: Bytes ordered by multikey quicksort before the blind tries take over.
SHALLOW = 32
#: Blocks of one anchor hash that one task sorts.  A hash with more is dealt out by
#: its strings: offset to the anchor and bytes, equal ones brought together on the map side.
HOT_BLOCKS = 2_048

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cache = _process_cache()
    if len(getattr(cache, "powers", ((),))[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        inverse = pow(_BASE, -1, 1 << 64)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        table = np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64)
        cache.powers = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64), table
    return cache.powers


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def blocks_of(data: bytes, length: int = LENGTH, gram: int = GRAM):
    """Arrays (anchor hash, block hash, anchor, first string, last string), or None.

    Strings first..last (starts, inclusive) share the anchor position.
    """
    n = len(data)
    if n < length:
        return None
    up, down, table = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(table[np.frombuffer(data, np.uint8)] * up[:n], out=total[1:])
    m, width = n - gram + 1, length - gram + 1
    h = _mix((total[gram:] - total[:m]) * down[:m])
    low = np.uint64(0xFFFFFFFF)
    key = (h & ~low) | (low - np.arange(m, dtype=np.uint64))
    span = 1
    while 2 * span <= width:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < width:
        key = np.minimum(key[: len(key) - (width - span)], key[width - span :])
    anchor = (low - (key & low)).astype(np.int64)
    cut = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    first, last = cut, np.r_[cut[1:], len(anchor)] - 1
    a = anchor[cut]
    body = (total[last + length] - total[first]) * down[first]
    shape = ((a - first) << 16 | (a - last)).astype(np.uint64)
    return h[a], _mix(body ^ (shape * np.uint64(0xD6E8FEB86659FD93))), a, first, last


# --- deep-shallow sorting ------------------------------------------------------


class _Node:
    __slots__ = ("depth", "children")

    def __init__(self, depth: int, children: dict):
        self.depth, self.children = depth, children


def blind_trie(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Order of ``strings`` (equal lengths) and each one's common prefix with the one before.

    Inner nodes keep a depth and branching bytes only: a string is led blindly
    to some leaf, compared with it once, and hung in at the first difference.
    """
    root: _Node | list[int] = [0]
    size = len(strings[0])
    for at in range(1, len(strings)):
        x, node = strings[at], root
        while node.__class__ is _Node:
            kids = node.children
            node = kids.get(x[node.depth]) or next(iter(kids.values()))
        y = strings[node[0]]
        if x == y:
            node.append(at)
            continue
        apart = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
        same = size - (apart.bit_length() + 7) // 8
        parent, node = None, root
        while node.__class__ is _Node and node.depth < same:
            parent, node = node, node.children[x[node.depth]]
        if node.__class__ is _Node and node.depth == same:
            node.children[x[same]] = [at]
            continue
        fork = _Node(same, {y[same]: node, x[same]: [at]})
        if parent is None:
            root = fork
        else:
            parent.children[x[parent.depth]] = fork
    order, lcp, stack = [], [], [(root, 0)]
    while stack:
        node, common = stack.pop()
        if node.__class__ is _Node:
            kids = sorted(node.children.items())
            stack += [(kid, node.depth) for _, kid in reversed(kids[1:])]
            stack.append((kids[0][1], common))
        else:
            order += node
            lcp += [common, *[size] * (len(node) - 1)]
    return order, lcp


def quicksort_to_depth(symbol: np.ndarray, starts: np.ndarray, group: np.ndarray, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of all groups side by side, eight bytes a symbol, down to ``shallow`` bytes.

    Each pass splits every open group three ways about its middle element's symbol: the
    smaller and the larger go on at the same depth, the equal eight bytes deeper.
    Returns (order, first): ``first`` marks where a group of suffixes equal to that depth begins.
    """
    n = len(starts)
    order, first = np.arange(n), np.r_[True, group[1:] != group[:-1]]
    depth = np.zeros(n, np.int64)
    at = np.arange(n)
    while len(at):
        # ``at``: positions of open groups, whole and in order.
        head = np.flatnonzero(first[at])
        size = np.diff(np.r_[head, len(at)])
        wanted = (size > 1) & (depth[at[head]] < shallow)
        at = at[np.repeat(wanted, size)]
        if not len(at):
            break
        size = size[wanted]
        head = np.cumsum(size) - size
        items, deep = order[at], depth[at]
        word = symbol[starts[items] + deep]
        pivot = np.repeat(word[head + size // 2], size)
        less, same = word < pivot, word == pivot
        n_less, n_same = np.add.reduceat(less, head, dtype=np.int64), np.add.reduceat(same, head, dtype=np.int64)
        upto_less, upto_same = np.cumsum(less), np.cumsum(same)
        base = np.repeat(np.stack([head, upto_less[head] - less[head], upto_same[head] - same[head], n_less, n_same]), size, axis=1)
        before_less, before_same = upto_less - less - base[1], upto_same - same - base[2]
        before = np.arange(len(at)) - base[0]
        to = base[0] + np.where(less, before_less, np.where(same, base[3] + before_same, base[3] + base[4] + before - before_less - before_same))
        order[at[to]] = items
        depth[at[to]] = deep + 8 * same
        own = at[head]
        for cut in (n_less, n_less + n_same):
            inside = cut < size
            first[own[inside] + cut[inside]] = True
    return order, first


def deep_shallow(buf: bytes, starts: np.ndarray, group: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW):
    """Sort suffixes of ``buf`` cut to ``length``, each group by itself.

    ``group``: ascending group numbers of ``starts``.  Returns (order, lcp):
    order indexes ``starts``; lcp is the common prefix with the one before in
    the same group, 0 for a group's first.  Multikey quicksort orders them down to
    ``shallow`` bytes; blind tries order what is equal there.
    """
    n = len(starts)
    if not n:
        return np.arange(0), np.zeros(0, np.int64)
    raw = np.frombuffer(buf + bytes(8), np.uint8).astype(np.uint64)
    symbol = np.zeros(len(buf), np.uint64)
    for j in range(8):
        symbol |= raw[j : j + len(buf)] << np.uint64(8 * (7 - j))
    group = np.asarray(group)
    order, first = quicksort_to_depth(symbol, starts, group, shallow)
    lcp = np.zeros(n, np.int64)
    own = group[order]
    open_ = np.flatnonzero(np.r_[False, own[1:] == own[:-1]])
    for depth in range(0, shallow, 8):
        apart = symbol[starts[order[open_]] + depth] ^ symbol[starts[order[open_ - 1]] + depth]
        equal = np.zeros(len(open_), np.int64)
        for b in range(1, 9):
            equal += (apart >> np.uint64(8 * (8 - b))) == 0
        lcp[open_] += equal
        open_ = open_[equal == 8]
    cut = np.flatnonzero(first)
    size = np.diff(np.r_[cut, n])
    for s, k in zip(cut[size > 1].tolist(), size[size > 1].tolist()):
        part = order[s : s + k]
        got, common = blind_trie([buf[p : p + length] for p in starts[part].tolist()])
        order[s : s + k] = part[got]
        lcp[s + 1 : s + k] = common[1:]
    return order, lcp


def _ranges(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of consecutive numbers in an ascending array, as (from, to) inclusive."""
    cut = np.flatnonzero(np.r_[True, x[1:] != x[:-1] + 1])
    return x[cut], x[np.r_[cut[1:], len(x)] - 1]


def _sort_blocks(length: int):
    """Repeated strings of distinct blocks, sorted group by group."""

    def solve(h, blk, n, ctx):
        # Equal rows bring the same block more than once.
        one = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (blk[1:] != blk[:-1])])
        h, blk, n, ctx = h[one], blk[one], n[one], [ctx[i] for i in one.tolist()]
        sizes = np.array([len(c) for c in ctx], np.int64)
        base = np.cumsum(sizes) - sizes
        strings = sizes - length + 1
        owner = np.repeat(np.arange(len(ctx)), strings)
        rel = np.arange(len(owner)) - np.repeat(np.cumsum(strings) - strings, strings)
        group = np.cumsum(np.r_[True, h[1:] != h[:-1]])
        order, lcp = deep_shallow(b"".join(ctx), base[owner] + rel, group[owner], length)
        twin = np.flatnonzero(lcp >= length)
        repeated = np.repeat(n > 1, strings)
        repeated[order[twin]] = True
        repeated[order[twin - 1]] = True
        at = np.flatnonzero(repeated)
        if not len(at):
            return pd.DataFrame({"h": [], "blk": [], "lo": [], "hi": []})
        o, r = owner[at], rel[at]
        cut = np.flatnonzero(np.r_[True, (r[1:] != r[:-1] + 1) | (o[1:] != o[:-1])])
        end = np.r_[cut[1:], len(at)] - 1
        return pd.DataFrame({"h": h[o[cut]], "blk": blk[o[cut]], "lo": r[cut], "hi": r[end]})

    def run(batches):
        held = None
        for b in batches:
            held = b if held is None else pd.concat([held, b], ignore_index=True)
            h = held["h"].to_numpy(np.int64)
            last = int(np.argmax(h == h[-1])) if len(h) else 0
            # The last hash may go on in the next batch.
            if last >= 1_000:
                part, held = held.iloc[:last], held.iloc[last:].reset_index(drop=True)
                for at in _portions(part["h"].to_numpy(np.int64)):
                    p = part.iloc[at]
                    yield solve(*(p[c].to_numpy(np.int64) for c in ("h", "blk", "n")), p["ctx"].tolist())
                release()
        if held is not None and len(held):
            for at in _portions(held["h"].to_numpy(np.int64)):
                p = held.iloc[at]
                yield solve(*(p[c].to_numpy(np.int64) for c in ("h", "blk", "n")), p["ctx"].tolist())

    return run


def _portions(h: np.ndarray, most: int = 1_000):
    """Slices of a sorted array that keep equal values together, about ``most`` each."""
    at = 0
    while at < len(h):
        end = min(at + most, len(h))
        if end < len(h):
            end = int(np.searchsorted(h, h[end - 1], side="right"))
        yield slice(at, end)
        at = end


# --- the operator ---------------------------------------------------------------


def _mark(length: int):
    """Blocks of each text.  Of blocks that a text holds more than once the first
    carries the count; all of them are known repeats, sent as merged ranges."""

    def run(batches):
        for b in (part for batch in batches for part in _slices(batch, 1_000)):
            out = ([], [], [], [], [], [], [])
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = blocks_of(text.encode("utf-8", "surrogatepass"), length)
                if got is None:
                    continue
                h, blk, a, first, last = got
                order = np.lexsort((np.arange(len(h)), blk, h))
                hs, bs = h[order], blk[order]
                lead = np.r_[True, (hs[1:] != hs[:-1]) | (bs[1:] != bs[:-1])]
                counts = np.diff(np.r_[np.flatnonzero(lead), len(h)])
                one = order[lead]
                rows = [(h[one].view(np.int64), blk[one].view(np.int64), (a - first)[one], first[one], last[one], counts)]
                if (counts > 1).any():
                    known = np.zeros(int(last[-1]) + 2, np.int64)
                    many = order[np.repeat(counts > 1, counts)]
                    np.add.at(known, first[many], 1)
                    np.add.at(known, last[many] + 1, -1)
                    lo, hi = _ranges(np.flatnonzero(np.cumsum(known) > 0))
                    zero = np.zeros(len(lo), np.int64)
                    rows.append((zero, zero, zero, lo, hi, zero))
                for r in rows:
                    out[0].append(pa.array([key] * len(r[0]), pa.binary()))
                    for x, v in zip(out[1:], r):
                        x.append(v)
            if out[0]:
                kinds = (np.int64, np.int64, np.int32, np.int32, np.int32, np.int32)
                cols = [pa.concat_arrays(out[0])] + [np.concatenate(x).astype(t) for x, t in zip(out[1:], kinds)]
                names = ("key", "h", "blk", "off", "first", "last", "n")
                yield pa.RecordBatch.from_pydict(dict(zip(names, cols)))
            release()

    return run


def _slices(batch, rows: int = 256):
    """A batch in small parts: only a part at a time becomes Python objects."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _lists(column) -> tuple[np.ndarray, list[np.ndarray]]:
    """Offsets and flat fields of a list<struct> array; a null list counts as empty."""
    sizes = np.asarray(column.value_lengths().fill_null(0))
    flat = column.flatten()
    fields = [f.to_numpy(zero_copy_only=False) for f in flat.flatten()]
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), fields


def _contexts(length: int):
    """The bytes of chosen blocks; for hot hashes those of every string, with its offset to the anchor."""

    def run(batches):
        for batch in batches:
            for b in _slices(batch):
                out = {k: [] for k in ("h", "blk", "n", "i", "rel", "ctx")}
                at, (h, blk, n, off, first, last, hot) = _lists(b.column(1))
                for row, text in enumerate(b.column(0).to_pylist()):
                    data = text.encode("utf-8", "surrogatepass")
                    for k in range(at[row], at[row + 1]):
                        p, q = int(first[k]), int(last[k])
                        if hot[k]:
                            for x in range(p, q + 1):
                                for name, v in zip(out, (h[k], blk[k], n[k], p + off[k] - x, x - p, data[x : x + length])):
                                    out[name].append(v)
                        else:
                            for name, v in zip(out, (h[k], blk[k], n[k], -1, 0, data[p : q + length])):
                                out[name].append(v)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_pydict({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds)})
            release()

    return run


def repeated_ranges(src: DataFrame, length: int = LENGTH, hot_blocks: int = HOT_BLOCKS) -> DataFrame:
    """(key, spans) for each ``key`` of ``src`` (key binary, text) with repeats.

    spans: array of (first, last) string starts, unordered, may overlap.  Equal
    keys stand for equal texts.  ``hot_blocks`` does not change the result.
    """
    spark = src.sparkSession
    marks = materialise(src.select("key", "text").mapInArrow(
        _mark(length), "key binary, h long, blk long, off int, first int, last int, n int"), "blocks")
    own = marks.where("n > 0")
    seen = own.groupBy("h").agg(F.sum("n").alias("all"), (F.min("blk") == F.max("blk")).alias("alike")).where("all > 1")
    dup = materialise(own.join(seen.drop("all"), "h"), "repeats")
    blocks = dup.where("not alike").groupBy("h", "blk").agg(
        F.sum("n").alias("n"), F.min(F.struct("key", "off", "first", "last")).alias("rep"))
    per_hash = blocks.groupBy("h").agg((F.count("*") > hot_blocks).alias("hot"))
    wanted = blocks.join(per_hash, "h").select("rep.*", "h", "blk", "n", "hot")
    by_text = wanted.groupBy("key").agg(F.collect_list(F.struct("h", "blk", "n", "off", "first", "last", "hot")).alias("want"))
    ctx = materialise(src.join(by_text, "key").select("text", "want").mapInArrow(
        _contexts(length), "h long, blk long, n long, i int, rel int, ctx binary"), "contexts")
    plain = ctx.where("i < 0").repartition(shuffle_partitions(spark), "h").sortWithinPartitions("h", "blk")
    sorted_out = plain.select("h", "blk", "n", "ctx").mapInPandas(_sort_blocks(length), "h long, blk long, lo int, hi int")
    # Equal rows bring strings more than once: those are repeats in any case, and telling them apart
    # would shuffle all hot strings again.
    hot = ctx.where("i >= 0")
    twice = hot.groupBy("h", "i", "ctx").agg(F.sum("n").alias("all")).where("all > 1").drop("all")
    # A row per block with its repeated strings as ranges: what is joined to the
    # documents' blocks stays one row a block.
    rels = hot.join(twice, ["h", "i", "ctx"]).groupBy("h", "blk").agg(F.sort_array(F.collect_set("rel")).alias("r"))
    lone = lambda step: F.filter("r", lambda x: ~F.array_contains(F.col("r"), x + step))
    counted = rels.select("h", "blk", F.arrays_zip(lone(-1).alias("lo"), lone(1).alias("hi")).alias("ranges"))
    found = sorted_out.groupBy("h", "blk").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges")).unionByName(counted)
    moved = F.transform("ranges", lambda r: F.struct((F.col("first") + r["lo"]).alias("first"), (F.col("first") + r["hi"]).alias("last")))
    whole = F.array(F.struct("first", "last"))
    spans = (
        dup.join(found, ["h", "blk"]).select("key", moved.alias("s"))
        .unionByName(dup.where("alike").select("key", whole.alias("s")))
        .unionByName(marks.where("n = 0").select("key", whole.alias("s")))
    )
    # Rows of one key have the same ranges: each is kept once, so that copies stay linear.
    return spans.groupBy("key").agg(F.flatten(F.collect_set("s")).alias("spans"))


def _cut(length: int, as_text: bool):
    """Cut the ranges out of each text; columns: the row's fields, then the four results."""

    def run(batches):
        for batch in batches:
            for b in _slices(batch):
                sizes, gone_n, runs_n, kept = [], [], [], []
                at, (first, last) = _lists(b.column("spans"))
                for row, text in enumerate(b.column("_text").to_pylist()):
                    data = text.encode("utf-8", "surrogatepass")
                    sizes.append(len(data))
                    lo, hi = at[row], at[row + 1]
                    if lo == hi:
                        gone_n.append(0)
                        runs_n.append(0)
                        kept.append(data)
                        continue
                    edge = np.zeros(len(data) + 1, np.int32)
                    np.add.at(edge, first[lo:hi], 1)
                    np.add.at(edge, last[lo:hi] + length, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    gone_n.append(int(gone.sum()))
                    runs_n.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                    kept.append(np.frombuffer(data, np.uint8)[~gone].tobytes())
                row = b.column("_row")
                last_one = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
                made = [pa.array(sizes, pa.int64()), pa.array(gone_n, pa.int64()), pa.array(runs_n, pa.int64()), last_one]
                names = [row.type.field(i).name for i in range(row.type.num_fields)]
                yield pa.RecordBatch.from_arrays([*row.flatten(), *made], [*names, "n_bytes", "n_removed", "n_spans", "kept"])
            release()

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, carry: list[str] | None = None, hot_blocks: int = HOT_BLOCKS, as_text: bool = False) -> DataFrame:
    """``carry`` columns (default: all) of every row with n_bytes, n_removed, n_spans and kept (binary).

    A null text is empty.  Texts of fewer than ``length`` bytes lose nothing.
    Rows that repeat another row's text whole lose all of it, as its strings
    start elsewhere too.  Bytes are cut as bytes: ``kept`` may end or begin
    inside a character; ``as_text`` makes it a string, without the characters
    that a cut runs through.  Columns of the four names are replaced.  Texts may be of any length;
    an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    made = ("n_bytes", "n_removed", "n_spans", "kept")
    keep = [c for c in (carry or docs.columns) if c not in made]
    text = F.coalesce(F.col("text"), F.lit(""))
    ident = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.md5(text)))
    src = docs.select(F.unhex(ident).alias("key"), text.alias("text"))
    spans = repeated_ranges(src, length, hot_blocks)
    row = F.struct(*[F.col(f"`{c}`") for c in keep])
    rows = docs.select(F.unhex(ident).alias("_key"), text.alias("_text"), row.alias("_row"))
    joined = rows.join(spans, rows._key == spans.key, "left").select("_row", "_text", "spans")
    fields = [T.StructField(f.name, f.dataType, True) for f in docs.select(*[f"`{c}`" for c in keep]).schema]
    kinds = (T.LongType(), T.LongType(), T.LongType(), T.StringType() if as_text else T.BinaryType())
    schema = T.StructType(fields + [T.StructField(c, k, True) for c, k in zip(made, kinds)])
    return joined.mapInArrow(_cut(length, as_text), schema)
