"""What the operators read from the session: shared folder, partitions, sizes."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session gets a folder of its machine; a cluster is refused, as its executors do not share one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


_SCRATCH: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that `stage` writes inside, but for those that outlive it, are deleted at the end."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for at in _SCRATCH.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str, outlives: bool = False, **options: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    if _SCRATCH and not outlives:
        _SCRATCH[-1].append(path)
    df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(frame: DataFrame, rows: int = 1000) -> DataFrame:
    """The frame; its session sends texts to Python in batches of at most `rows` rows, where it still has Spark's default for short rows."""
    spark, key = frame.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) == 10_000:
        spark.conf.set(key, str(rows))
    return frame


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def size_of(df: DataFrame) -> int:
    """Bytes of all that a plan reads, after Spark's own estimate of its leaves (files, for tables); 0 where it knows none."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    return size if size < 1 << 60 else 0


def packed_rest(docs: DataFrame, *own: str) -> tuple[DataFrame, list]:
    """docs with the columns `own` (cast as given: (name, type)), and all others in one struct `rest` of plain names, so that no name of theirs can clash; and the expressions that give docs' columns back."""
    from pyspark.sql import functions as F

    named = {c.split()[0]: c.split()[1] for c in own}
    others = [f for f in docs.schema if f.name not in named]
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    rest = F.struct(F.lit(True).alias("_"), *(quoted(f.name).alias(f"c{i}") for i, f in enumerate(others)))
    place = {f.name: i for i, f in enumerate(others)}
    kinds = {f.name: f.dataType for f in docs.schema}
    back = [F.col(c).cast(kinds[c]).alias(c) if c in named else F.col("rest")[f"c{place[c]}"].alias(c) for c in docs.columns]
    return docs.select(*(F.col(c).cast(t).alias(c) for c, t in named.items()), rest.alias("rest")), back


def plain_names(docs: DataFrame, *own: str) -> DataFrame:
    """docs with all columns but `own` under plain names, by place, so that Python operators take columns of any name."""
    return docs.toDF(*(c if c in own else f"_{i}" for i, c in enumerate(docs.columns)))
