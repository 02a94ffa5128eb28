"""Merkle manifest of a dataset: a digest for every row, source and the whole, and a proof for every row.

A row is a leaf.  A source's leaves ascend by id; every ``ARITY`` consecutive nodes
(the last run may be shorter) become one, until one is left: the source's subroot.
Subroots, in the order of their sources, become the root in the same way.

Nodes meet as in combineByKey, driven by what arrives.  A parent's key is (tree,
level, run); a task keeps partial parents that gather indexed child digests.  How
many children a parent has follows from the tree's size, so the child that completes
it makes the parent's digest at once, and that goes to the next level as a child.
Leaves lie in order, so nearly all of this happens where they lie; what a task
cannot complete, the frontier, is shuffled by its parent's key and met again.
Every completed run keeps its children, a link from the parent back to them; paths
to the root grow down these links, and a proof is a leaf's path.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, materialise, scratch, shuffle_partitions

ARITY = 16
#: Partial parents that a task holds; beyond, their children go on as frontier.
HELD = 50_000
#: The tree over the sources' subroots.
TOP = -1
_NODE = "tree long, n long, level int, pos long, digest string"


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """A value in a leaf: ``-`` if null, else its UTF-8 byte count, a colon and itself."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(*fields: Column) -> Column:
    """Lowercase hex sha256 of the fields, one after the other."""
    return sha(F.concat(*[field(c) for c in fields]))


def tampered_fields(docs: DataFrame) -> tuple[Column, Column]:
    """(is the row tampered with, its text then): where 5 divides the id's crc32, A-Z are lower-cased; never for a null id."""
    hit = F.coalesce(F.crc32(docs.doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return hit, F.when(hit, ascii_lower(docs.text)).otherwise(docs.text)


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, has_source, src, leaf, tampered_leaf, row): digests only, texts go no further.

    A null source and an empty one are two sources.  ``row`` parts rows that are equal.
    """
    rest = [docs.doc_id, docs.source, docs.lang, docs.n_chars]
    hit, changed = tampered_fields(docs)
    return docs.select(
        docs.doc_id, docs.source.isNotNull().alias("has_source"), F.coalesce(docs.source, F.lit("")).alias("src"), leaf_digest(*rest, docs.text).alias("leaf"),
        F.when(hit, leaf_digest(*rest, changed)).alias("tampered_leaf"), F.monotonically_increasing_id().alias("row"),
    )


def _in_order(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` in ranges of the order, as a table: range ``rg`` and place ``at`` in it."""
    parts = shuffle_partitions(rows.sparkSession)
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    out = ranged.select(*rows.columns, F.shiftright("_m", 33).alias("rg"), F.col("_m").bitwiseAND((1 << 33) - 1).alias("at"))
    return materialise(out, "ordered")


def placed(rows: DataFrame) -> tuple[DataFrame, int]:
    """(leaves with tree, n and pos, number of sources).

    tree: the source's place among the sources, null first, then bytewise; n: its
    leaves; pos: the leaf's place among them by id (null first; equal ids by digest).
    """
    source = ["has_source", "src"]
    ordered = _in_order(rows, *source, "doc_id", "leaf", "row")
    # A source has a row per range that it reaches into, so none is met by all its leaves.
    held = ordered.groupBy("rg", *source).agg(F.count("*").alias("c"), F.min("at").alias("low"))
    own = Window.partitionBy(*source)
    held = held.withColumn("n", F.sum("c").over(own)).withColumn("before", F.sum("c").over(own.orderBy("rg")) - F.col("c"))
    sources = _in_order(held.select(*source).distinct(), *source)
    per_range = sources.groupBy("rg").agg(F.count("*").alias("c"))
    # One row a range.
    offset = per_range.select("rg", (F.sum("c").over(Window.orderBy("rg")) - F.col("c")).alias("first"))
    numbered = sources.join(offset, "rg").select(*source, (F.col("first") + F.col("at")).alias("tree"))
    where = held.join(numbered, source).drop("c")
    out = ordered.join(where, ["rg", *source]).select("doc_id", "leaf", "tampered_leaf", "tree", "n", (F.col("before") + F.col("at") - F.col("low")).alias("pos"))
    return out, sources.count()


# --- partial parents -----------------------------------------------------------


def width(n: int, level: int, arity: int = ARITY) -> int:
    """Nodes of a tree of ``n`` leaves at ``level``."""
    return -(-n // arity**level)


class Partial:
    """Partial parents of one task.  ``put`` takes a node and returns what it completes."""

    def __init__(self, n_trees: int, arity: int = ARITY):
        self.n_trees, self.arity, self.open = n_trees, arity, {}

    def put(self, tree: int, n: int, level: int, pos: int, digest: str) -> list[tuple]:
        """Completed runs (tree, n, level, run, children, digest); run -1 stands for the root of a tree."""
        made = []
        while True:
            size = width(n, level, self.arity)
            if size == 1:
                made.append((tree, n, level, -1, "", digest))
                if tree == TOP:
                    return made
                tree, n, level, pos = TOP, self.n_trees, 0, tree
                continue
            run, at = divmod(pos, self.arity)
            gathered = self.open.setdefault((tree, n, level, run), {})
            gathered[at] = digest
            if len(gathered) < min(self.arity, size - run * self.arity):
                return made
            del self.open[tree, n, level, run]
            kids = "".join(gathered[k] for k in range(len(gathered)))
            digest = hashlib.sha256(kids.encode()).hexdigest()
            made.append((tree, n, level, run, kids, digest))
            level, pos = level + 1, run

    def rest(self):
        """The frontier: children whose parent is not complete."""
        for (tree, n, level, run), gathered in self.open.items():
            for at, digest in gathered.items():
                yield tree, n, level, run * self.arity + at, None, digest
        self.open.clear()


def _combine(n_trees: int, arity: int):
    names, kinds = ("tree", "n", "level", "pos", "kids", "digest"), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string())

    def batch(rows):
        return pa.RecordBatch.from_pydict({k: pa.array(v, t) for k, t, v in zip(names, kinds, zip(*rows))})

    def run(batches):
        partial, out = Partial(n_trees, arity), []
        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(5))):
                out += partial.put(*row)
            if len(partial.open) > HELD:
                out += partial.rest()
            if out:
                yield batch(out)
                out = []
        out += partial.rest()
        for at in range(0, len(out), 10_000):
            yield batch(out[at : at + 10_000])

    return run


def build(nodes: DataFrame, n_trees: int, arity: int = ARITY) -> DataFrame:
    """All completed runs over leaf ``nodes`` (tree, pos, n, leaf): tree, n, level, pos (the run; -1: a tree's root), kids, digest.

    Each round completes at least every frontier run whose children are all there, so
    there are at most as many rounds as levels, over ever fewer rows.
    """
    made, now = [], nodes.select("tree", "n", F.lit(0).alias("level"), "pos", F.col("leaf").alias("digest"))
    while True:
        done = materialise(now.mapInArrow(_combine(n_trees, arity), "tree long, n long, level int, pos long, kids string, digest string"), "runs")
        made.append(done.where("kids is not null"))
        frontier = done.where("kids is null").select("tree", "n", "level", "pos", "digest")
        if frontier.isEmpty():
            break
        now = frontier.repartition(shuffle_partitions(nodes.sparkSession), "tree", "level", F.floor(F.col("pos") / arity))
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out


# --- reverse links --------------------------------------------------------------


def _up(tree: Column, level: Column, pos: Column, size: Column, arity: int) -> Column:
    """The run that a node is a child of: in its own tree, or its tree's place in the tree on top."""
    own = F.struct(tree.alias("tree"), level.cast("int").alias("level"), F.floor(pos / arity).alias("run"), (pos % arity).cast("int").alias("at"))
    top = F.struct(F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.floor(tree / arity).alias("run"), (tree % arity).cast("int").alias("at"))
    return F.when(size > 1, own).when(tree != TOP, top)


def paths(runs: DataFrame, n_trees: int, arity: int = ARITY) -> DataFrame:
    """(tree, level, run, kids, path) of every run; path: steps (at, kids) from the run's own digest up to the root."""
    own = runs.where("pos >= 0").withColumnRenamed("pos", "run")
    size = F.ceil(F.col("n") / F.pow(F.lit(float(arity)), F.col("level") + 1))
    up = own.withColumn("up", _up(F.col("tree"), F.col("level") + 1, F.col("run"), size, arity))
    tops = 0
    while width(n_trees, tops, arity) > 1:
        tops += 1
    height = F.lit(0)
    # Levels above the run's own: size by size, as logarithms are not exact.
    for k in range(1, 17):
        height = height + (F.col("n") > F.pow(F.lit(float(arity)), F.col("level") + k)).cast("int")
    up = materialise(up.withColumn("depth", height + F.when(F.col("tree") == TOP, 0).otherwise(tops)), "links")
    deepest = up.agg(F.max("depth")).first()[0]
    empty = F.array().cast("array<struct<at:int,kids:string>>")
    out = last = up.where("up is null").select("tree", "level", "run", "kids", empty.alias("path"))
    for depth in range(1, (deepest or 0) + 1):
        above = last.select(F.col("tree").alias("t"), F.col("level").alias("l"), F.col("run").alias("r"), F.col("kids").alias("k"), "path")
        here = up.where(F.col("depth") == depth)
        met = here.join(above, (here.up["tree"] == above.t) & (here.up["level"] == above.l) & (here.up["run"] == above.r))
        step = F.array(F.struct(F.col("up.at").alias("at"), F.col("k").alias("kids")))
        last = met.select("tree", "level", "run", "kids", F.concat(step, "path").alias("path"))
        if depth < deepest:
            last = materialise(last, "paths")
        out = out.unionByName(last)
    return out


def siblings(step: Column) -> Column:
    """A run's other children, left to right."""
    return F.concat(F.substring(step["kids"], F.lit(1), step["at"] * 64), F.substring(step["kids"], step["at"] * 64 + 65, F.length(step["kids"])))


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path give."""

    def up(acc: Column, s: Column) -> Column:
        return F.sha2(F.concat(F.substring(s["kids"], F.lit(1), s["at"] * 64), acc, F.substring(s["kids"], s["at"] * 64 + 65, F.length(s["kids"]))).cast("binary"), 256)

    return F.aggregate(path, digest, up)


@dataclass
class Manifest:
    """A dataset's manifest: ``leaves`` (doc_id, leaf, tampered_leaf, tree, n, pos), ``runs`` and the sources' count."""

    leaves: DataFrame
    runs: DataFrame
    n_trees: int
    arity: int = ARITY

    @property
    def root(self) -> str | None:
        """The dataset's digest; None for an empty table."""
        got = self.runs.where((F.col("tree") == TOP) & (F.col("pos") == -1)).select("digest").first()
        return got[0] if got else None

    def proofs(self) -> DataFrame:
        """``leaves`` with path (steps from the leaf to the root), subroot and root."""
        path = paths(self.runs, self.n_trees, self.arity).withColumnsRenamed({"tree": "t", "level": "l", "run": "r"})
        own = self.leaves.withColumn("up", _up(F.col("tree"), F.lit(0), F.col("pos"), F.col("n"), self.arity))
        met = own.join(path, (own.up["tree"] == path.t) & (own.up["level"] == path.l) & (own.up["run"] == path.r), "left")
        step = F.array(F.struct(F.col("up.at").alias("at"), "kids"))
        whole = F.when(F.col("kids").isNull(), F.array().cast("array<struct<at:int,kids:string>>")).otherwise(F.concat(step, "path"))
        subroots = self.runs.where("tree >= 0 and pos = -1").select(F.col("tree").alias("_t"), F.col("digest").alias("subroot"))
        rows = met.withColumn("steps", whole).join(subroots, F.col("tree") == F.col("_t"))
        return rows.select(*self.leaves.columns, F.col("steps").alias("path"), "subroot", F.lit(self.root).alias("root"))


def manifest(docs: DataFrame, arity: int = ARITY) -> Manifest:
    """The manifest of ``docs`` (doc_id, source, lang, n_chars, text; further columns take no part).

    Any of the five may be null.  Repeated rows are leaves each; equal ids are ordered
    by digest, a null id comes first.  An empty table has no leaves, runs or root.
    """
    with scratch(docs.sparkSession) as keep:
        rows, n_trees = placed(leaves(docs))
        rows = keep(materialise(rows, "leaves"))
    return Manifest(rows, build(rows, n_trees, arity), n_trees, arity)


def verify(docs: DataFrame, arity: int = ARITY) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: whether a tampered row is found out by its proof."""
    rows = manifest(docs, arity).proofs()
    folded = fold(F.coalesce("tampered_leaf", "leaf"), F.col("path"))
    out = rows.select(
        "doc_id", "leaf", "subroot", "root", sha(F.concat_ws("", F.transform("path", siblings))).alias("proof_sha256"), folded.alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
