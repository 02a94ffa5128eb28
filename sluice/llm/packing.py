"""Best-fit packing of tokenised documents by linear grouping.

Lengths are at most the capacity, so a histogram of lengths says all that a
packing needs and the plan is made on the driver from at most ``capacity``
counts, whatever the corpus.  Large lengths are dealt into groups of equal
cardinality and rounded up to their group's largest; configurations of the few
rounded sizes are optimised; actual lengths take the slots, and small ones
best-fit into what is left.  A plan block is a number of alike sequences, so
documents find their place from their length and rank among equals alone.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _process_cache, fresh, materialise, release, small_batches

CAPACITY, END_ID = 2_048, 0
#: Lengths over this share of the capacity count as large.
LARGE = 1 / 6
#: Group counts that are tried; the plan with the fewest sequences is kept.
GROUPS = (96, 512)
#: Words that one worker remembers the ids of: for good, and until they are too many.
CACHE_WORDS, LATE_WORDS = 250_000, 100_000
#: Pieces of one length that are ranked together: a length with more is ranked in
#: as many parts as it takes, so that a common length is no hot key.
RANK_ROWS = 100_000


# --- tokens -----------------------------------------------------------------


def _tokenizer(path: str):
    cache = _process_cache()
    kept = getattr(cache, "packing", None)
    if kept is None or kept[0] != path:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        ends = np.zeros(tok.get_vocab_size(), bool)
        ends[[i for t, i in tok.get_vocab().items() if t.endswith("</w>")]] = True
        kept = cache.packing = (path, tok, ends, {}, [])
    return kept[1:]


#: Marks after a letter and before white space are a pre-token of their own.
_TAIL = re.compile(r"[!-&(-/:-@\[-`{-~](?<=[a-z\xdf-\xf6\xf8-\xff].)[!-&(-/:-@\[-`{-~]*(?=\s|$)")
#: A word of these is one pre-token.
_PLAIN = re.compile(r"[a-z\xdf-\xf6\xf8-\xff]+")


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _words(text: str) -> list[str]:
    """White-space pieces of a text with the same ids as the text, fewer of them distinct.

    Added tokens are matched before case is folded, so a text that may hold one stays as it is.
    """
    if "<|" not in text and _latin(text):
        text = _TAIL.sub(r" \g<0>", text.lower())
    for gap in "\n\t\r\x0b\x0c":
        text = text.replace(gap, " ")
    return text.split(" ")


def _learn(new: list[str], tok, ends: np.ndarray, known: dict[str, bytes]) -> None:
    """Tokenise words not met before: plain ones joined, since their last ids are marked."""
    plain = [w for w in new if _PLAIN.fullmatch(w)]
    for i in range(0, len(plain), 500):
        part = plain[i : i + 500]
        ids = np.array(tok.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
        cut = np.flatnonzero(ends[ids]) + 1
        if len(cut) != len(part):
            raise AssertionError("a plain word is not one pre-token of this vocabulary")
        raw, at = ids.tobytes(), 0
        for w, end in zip(part, (4 * cut).tolist()):
            known[w] = raw[at:end]
            at = end
    rest = [w for w in new if w not in known]
    for w, e in zip(rest, tok.encode_batch_fast(rest, add_special_tokens=False) if rest else ()):
        known[w] = np.array(e.ids, "<u4").tobytes()


def encode_batch(texts: list[str], path: str) -> list[bytes]:
    """Little-endian 32-bit ids of whole texts, without special tokens added.

    The vocabulary drops white space and never joins across it, so a text's
    ids are its words' ids in order; each word is tokenised once per worker.
    """
    tok, ends, known, late = _tokenizer(path)
    split = [_words(t) for t in texts]
    if len(late) > LATE_WORDS:
        for w in late:
            del known[w]
        late.clear()
    new = list(set().union(*split).difference(known))
    if new:
        # Words met first are mostly the frequent ones: they stay.
        if len(known) >= CACHE_WORDS:
            late += new
        _learn(new, tok, ends, known)
    return [b"".join(map(known.__getitem__, ws)) for ws in split]


def pieces(docs: DataFrame, tokenizer_path: str, carry: tuple[str, ...] = ("doc_id",), capacity: int = CAPACITY) -> DataFrame:
    """Per piece: ``carry`` columns, piece, start, length, ids_crc32.

    A document is its ids and one END_ID; only longer ones are cut.  A null
    text is empty: a piece of one id.
    """
    step, end = 4 * capacity, np.array([END_ID], "<u4").tobytes()

    def cut(batches):
        for b in batches:
            for at in range(0, len(b), 500):
                part = b.iloc[at : at + 500]
                row, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(encode_batch([t or "" for t in part["_text"]], tokenizer_path)):
                    ids += end
                    for k, p in enumerate(range(0, len(ids), step)):
                        x = ids[p : p + step]
                        row.append(i)
                        piece.append(k)
                        start.append(p // 4)
                        length.append(len(x) // 4)
                        crc.append(zlib.crc32(x))
                out = part.iloc[row].drop(columns="_text").reset_index(drop=True)
                yield out.assign(piece=np.array(piece, np.int32), start=np.array(start, np.int64), length=np.array(length, np.int64), ids_crc32=np.array(crc, np.int64))
            release()

    rows = docs.select(*carry, F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text")
    return rows.mapInPandas(cut, f"{kept}, piece int, start long, length long, ids_crc32 long")


# --- plan -------------------------------------------------------------------


class _Plan:
    """Blocks of alike sequences: [sequences, room, [(length, first rank, offset)], first id]."""

    def __init__(self, capacity: int):
        self.capacity, self.blocks, self.rank = capacity, [], np.zeros(capacity + 1, np.int64)

    def take(self, length: int, n: int) -> int:
        r = int(self.rank[length])
        self.rank[length] += n
        return r

    def add(self, n: int, items: list[int]) -> int:
        entries, offset = [], 0
        for x in items:
            entries.append((x, self.take(x, n), offset))
            offset += x
        self.blocks.append([n, self.capacity - offset, entries])
        return len(self.blocks) - 1

    def split(self, at: int, n: int) -> int:
        """Cut the first ``n`` sequences off block ``at``; their index."""
        m, room, entries = self.blocks[at]
        if n == m:
            return at
        self.blocks.append([n, room, list(entries)])
        self.blocks[at] = [m - n, room, [(x, r + n, o) for x, r, o in entries]]
        return len(self.blocks) - 1

    def put(self, at: int, length: int, copies: int) -> None:
        n, room, entries = self.blocks[at]
        for _ in range(copies):
            entries.append((length, self.take(length, n), self.capacity - room))
            room -= length
        self.blocks[at][1] = room


def _configurations(sizes: list[int], demand: list[int], capacity: int):
    """Yield (times, [count per size]): the largest size left, filled up best."""
    demand, k = list(demand), len(sizes)
    while True:
        lead = next((i for i in range(k) if demand[i]), None)
        if lead is None:
            return
        room = capacity - sizes[lead]
        # Reachable sums with bounded counts; by[s]: last size that reaches s, used[s]: how many of it.
        by, used = np.full(room + 1, -1, np.int64), np.zeros(room + 1, np.int64)
        by[0] = k
        for i in range(lead, k):
            s, most = sizes[i], demand[i] - (i == lead)
            if s > room or most <= 0:
                continue
            before = np.flatnonzero(by >= 0)
            for c in range(1, min(most, room // s) + 1):
                to = before + c * s
                to = to[to <= room]
                to = to[by[to] < 0]
                by[to], used[to] = i, c
        fill = int(np.flatnonzero(by >= 0)[-1])
        counts = [0] * k
        counts[lead] += 1
        while fill:
            i, c = int(by[fill]), int(used[fill])
            counts[i] += c
            fill -= c * sizes[i]
        times = min(demand[i] // c for i, c in enumerate(counts) if c)
        for i, c in enumerate(counts):
            demand[i] -= c * times
        yield times, counts


def _grouped(counts: np.ndarray, cut: int, groups: int):
    """Equal-cardinality groups of the large lengths, longest first: lists of [length, n]."""
    large = [[x, int(counts[x])] for x in range(len(counts) - 1, cut, -1) if counts[x]]
    total, out, filled = sum(n for _, n in large), [], 0
    per = max(1, -(-total // groups))
    for x, n in large:
        while n:
            if not filled:
                out.append([])
            t = min(n, per - filled)
            out[-1].append([x, t])
            n -= t
            filled = (filled + t) % per
    return out


def _draw(pool: list[list[int]], n: int) -> list[tuple[int, int]]:
    """Take ``n`` lengths off the front of a pool, as (length, count) runs."""
    out = []
    while n:
        x, have = pool[0]
        t = min(n, have)
        out.append((x, t))
        n -= t
        if t == have:
            pool.pop(0)
        else:
            pool[0][1] -= t
    return out


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = 96) -> _Plan:
    """Place every length of the histogram; the plan's blocks hold all of them."""
    counts = np.zeros(capacity + 1, np.int64)
    for x, n in histogram.items():
        counts[x] += n
    plan = _Plan(capacity)
    if counts[capacity]:
        plan.add(int(counts[capacity]), [capacity])
        counts[capacity] = 0
    cut = int(capacity * LARGE)
    dealt = _grouped(counts, cut, groups)
    # Groups of one rounded size are one size.
    sizes, pools = [], []
    for g in dealt:
        if sizes and sizes[-1] == g[0][0]:
            pools[-1].extend(g)
        else:
            sizes.append(g[0][0])
            pools.append(list(g))
    demand = [sum(n for _, n in p) for p in pools]
    for times, config in _configurations(sizes, demand, capacity):
        # Each slot gets the next ``times`` actual lengths of its group, as runs.
        slots = [_draw(pools[i], times) for i, c in enumerate(config) for _ in range(c)]
        # Sequences are alike between the points where some slot's length changes.
        ends = sorted({e for runs in slots for e in np.cumsum([n for _, n in runs]).tolist()})
        at, done = [0] * len(slots), 0
        upto = [runs[0][1] for runs in slots]
        for end in ends:
            plan.add(end - done, [runs[k][0] for runs, k in zip(slots, at)])
            for j, runs in enumerate(slots):
                if upto[j] == end and end < times:
                    at[j] += 1
                    upto[j] += runs[at[j]][1]
            done = end
    _best_fit(plan, counts, cut)
    return plan


def _best_fit(plan: _Plan, counts: np.ndarray, cut: int) -> None:
    """Small lengths, longest first, each into the least room that holds it."""
    rooms: dict[int, list[int]] = {}
    for at, (_, room, _) in enumerate(plan.blocks):
        rooms.setdefault(room, []).append(at)
    order = sorted(rooms)

    def file(at: int) -> None:
        room = plan.blocks[at][1]
        if room not in rooms or not rooms[room]:
            if room not in rooms:
                rooms[room] = []
            i = bisect_left(order, room)
            if i == len(order) or order[i] != room:
                order.insert(i, room)
        rooms[room].append(at)

    for x in range(min(cut, plan.capacity - 1), 0, -1):
        left = int(counts[x])
        while left:
            i = bisect_left(order, x)
            while i < len(order) and not rooms[order[i]]:
                del order[i]
            if i == len(order):
                each = plan.capacity // x
                n = max(1, left // each)
                each = min(each, left)
                file(plan.add(n, [x] * each))
                left -= n * each
                continue
            room = order[i]
            at = rooms[room].pop()
            each = min(room // x, left)
            n = min(plan.blocks[at][0], left // each)
            part = plan.split(at, n)
            if part != at:
                file(at)
            plan.put(part, x, each)
            file(part)
            left -= n * each


def best_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> _Plan:
    plans = [make_plan(histogram, capacity, g) for g in GROUPS]
    return min(plans, key=lambda p: sum(b[0] for b in p.blocks))


def place_table(plan: _Plan) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), by length and rank."""
    rows, seq = [], 0
    for n, _, entries in plan.blocks:
        rows += [(x, r, seq, o) for x, r, o in entries]
        seq += n
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


# --- packing ----------------------------------------------------------------


def pack(docs: DataFrame, tokenizer_path: str, carry: tuple[str, ...] = ("doc_id",), capacity: int = CAPACITY) -> DataFrame:
    """Per piece of ``docs``: ``carry`` columns, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts are empty documents; texts may be of any length; repeated rows are
    packed each; an empty table gives no rows.  ``carry`` must name none of the made columns.  A piece that fills a sequence is one (its number is
    negative); all others find their place by rank among those of their length.
    """
    if clash := {"piece", "start", "length", "ids_crc32", "sequence_id", "offset", "_text"}.intersection(c.lower() for c in carry):
        raise ValueError(f"carried columns have names of made ones: {sorted(clash)}")
    small_batches(docs.sparkSession)
    (mid, part, rank, at) = fresh(docs.select(*carry), "_mid", "_part", "_rank", "_at")
    cut = materialise(pieces(docs, tokenizer_path, carry, capacity).withColumn(mid, F.monotonically_increasing_id()), "pieces")
    out = [c for c in cut.columns if c != mid]
    short = cut.where(F.col("length") < capacity)
    # A row per length.
    counts = {r["length"]: r["count"] for r in short.groupBy("length").count().collect()}
    parts = np.array([-(-counts.get(x, 1) // RANK_ROWS) for x in range(capacity)], np.int64)
    spread = F.pmod(F.col(mid), F.element_at(F.array(*[F.lit(int(n)) for n in parts]), (F.col("length") + 1).cast("int"))).cast("int")
    short = short.withColumn(part, spread)
    # A row per length and RANK_ROWS pieces of it.
    tally = short.groupBy("length", F.col(part).alias("part")).agg(F.count("*").alias("n")).toPandas().sort_values(["length", "part"])
    table = place_table(best_plan(counts, capacity))
    base = np.cumsum(parts) - parts
    first_of = np.zeros(int(parts.sum()), np.int64)
    if len(tally):
        before = tally.groupby("length")["n"].cumsum() - tally["n"]
        first_of[base[tally["length"].to_numpy()] + tally["part"].to_numpy()] = before.to_numpy()
    code = table[:, 0] << 44 | table[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, own: pd.Series, nth: pd.Series) -> pd.DataFrame:
        x = length.to_numpy(np.int64)
        r = first_of[base[x] + own.to_numpy(np.int64)] + nth.to_numpy(np.int64)
        row = table[np.searchsorted(code, x << 44 | r, side="right") - 1]
        return pd.DataFrame({"sequence_id": row[:, 2] + r - row[:, 1], "offset": row[:, 3]})

    order = Window.partitionBy("length", part).orderBy(mid)
    ranked = short.withColumn(rank, (F.row_number().over(order) - 1).cast("long")).withColumn(at, place("length", part, rank))
    full = cut.where(F.col("length") == capacity).select(*out, (-1 - F.col(mid)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return ranked.select(*out, f"{at}.*").unionByName(full)
