"""Helpers shared by the corpus operators: tables, folds and the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}

#: Rows and bytes of texts that a worker takes from an Arrow batch at a time. Spark bounds the
#: batch itself by bytes; what Python makes of a batch takes several times its size.
ROWS, BYTES = 256, 4 << 20

#: Bytes of input for a partition that is read together with others.
PART = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that setting is missing and driver and executors are one process (unit
    tests) a temporary folder of this process stands in; on a cluster this raises.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if "dir" not in _LOCAL:
            _LOCAL["dir"] = tempfile.mkdtemp(prefix="sitewise-")
        where = f"file://{_LOCAL['dir']}"
    return where.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/sitewise/{name}-{uuid.uuid4().hex}"


def few(df: DataFrame) -> DataFrame:
    """``df`` in as few partitions as keep all cores busy; rows and their order in them stay.

    A task that writes a file on a local or mounted folder starts ``chmod`` for its folder, its file
    and its checksums. Until such a child runs its own program it shares the pages of the executor,
    and who adds up processes counts the executor's memory twice: small files are to be avoided.
    Partitions are only read one after another, never shuffled: one for each core at least, and more
    so that none has more than about ``PART`` bytes of input or 32 shuffle partitions.
    """
    spark, leaves = df.sparkSession, df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.coalesce(min(max(spark.sparkContext.defaultParallelism, -(-size // PART), -(-shuffled // 32)), (1 << 31) - 1))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs no recomputation of what is stored.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sliced(batches: Iterator, text: str | int, rows: int = ROWS, size: int = BYTES) -> Iterator:
    """Views of Arrow batches with at most ``rows`` rows and about ``size`` bytes in column
    ``text``; a longer text is a view of its own."""
    import pyarrow.compute as pc

    for b in batches:
        lengths = pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(text) if isinstance(text, str) else text)), 0).to_pylist()
        first = held = 0
        for i, n in enumerate(lengths):
            if i > first and (held + n > size or i - first >= rows):
                yield b.slice(first, i - first)
                first, held = i, 0
            held += n
        if first < b.num_rows:
            yield b.slice(first)


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``; null ids fall in fold 0."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % folds, F.lit(0))


def hashed_sample(df: DataFrame, key: str, rows: int, most: int, seed: int = 0) -> DataFrame:
    """About ``most`` of ``rows`` rows, chosen by a hash of ``key`` (all if fewer)."""
    if rows <= most:
        return df
    share = int(most / rows * 1_000_000)
    return df.filter(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) < share)
