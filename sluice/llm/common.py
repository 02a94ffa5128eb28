"""Shared helpers: shared-folder tables, column guards, process-wide caches."""

from __future__ import annotations

import contextlib
import sys
import tempfile
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes that are neither space nor TAB..CR.
WORD_GAP = r"[\x20\x09-\x0D]+"


#: Paths of the tables made since the innermost ``scratch`` began.
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Where neither is set, a session on one machine gets a temporary folder; on a
    cluster that would lose rows, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        holder = _process_cache()
        root = getattr(holder, "shared_root", None)
        if root is None:
            root = holder.shared_root = "file://" + tempfile.mkdtemp(prefix="sluice-")
    return root.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts lineage the way ``checkpoint()`` does, with columnar files in
    place of serialised rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sluice-{name}-{uuid.uuid4().hex}"
    _made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that no later plan reads."""
    for df in tables:
        conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/sluice-" in parent:
                path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(parent)
                path.getFileSystem(conf).delete(path, True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """What is materialised inside goes at the end, but for the tables given to the function that this yields."""
    outer, stay = _made[:], set()
    del _made[:]
    try:
        yield lambda df: stay.update(f.rsplit("/", 1)[0].rsplit("/", 1)[1] for f in df.inputFiles()) or df
    finally:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for at in _made:
            if at.rsplit("/", 1)[1] not in stay:
                path = jvm.org.apache.hadoop.fs.Path(at)
                path.getFileSystem(conf).delete(path, True)
        _made[:] = outer + [at for at in _made if at.rsplit("/", 1)[1] in stay]


def words(text: Column) -> Column:
    """The words of a text, in order, repeats included; null counts as empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def count_words(text: Column) -> Column:
    """How many words a text has, without building them."""
    gaps = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return gaps.cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other letter stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Bytes of one Arrow batch: texts may be long, and a batch lies in the JVM's and
#: the worker's memory at once.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by bytes, if they are not already."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def fresh(df: DataFrame, *wanted: str) -> tuple[str, ...]:
    """Names for helper columns that clash with no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return tuple(out)


def parallelism(spark: SparkSession) -> int:
    """Tasks that run at once, at least 1."""
    return max(1, spark.sparkContext.defaultParallelism)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _process_cache():
    """A module object that outlives one task: workers are reused."""
    return sys.modules.setdefault("_sluice_process_cache", types.ModuleType("_sluice_process_cache"))


def release() -> None:
    """Give memory that a batch has freed back to the system.

    Workers are reused and share an executor's memory with the JVM, so what one
    batch needed at its peak must not stay with the worker.
    """
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: it has its own ways
