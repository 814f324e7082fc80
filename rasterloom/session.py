"""Session plumbing shared by the whole library.

* :func:`ship` makes the package importable on the Python workers of any
  cluster (``sys.path`` edits of the driver do not reach them), and bounds the
  batches of texts that scans and workers hold.
* :func:`shared_dir` is the folder every executor can read; it comes from
  ``spark.checkpoint.dir`` and is only made up where that setting is absent.
* :func:`stored` cuts a lineage with a table written there.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Whole texts are long, and rows alone bound nothing: bytes of an Arrow batch that goes to a Python worker, about, and rows of a scan's batch.
_BOUNDS = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20), "spark.sql.parquet.columnarReaderBatchSize": "512"}
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, and bound the batches of the session."""
    bound_batches(spark)
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="rasterloom-")) / "rasterloom-src.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, os.path.join(root.name, p.relative_to(root)))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


def bound_batches(spark: SparkSession) -> None:
    """Bounds for batches of whole texts, where the application's settings have none."""
    set_by_user = spark.sparkContext.getConf()
    for key, value in _BOUNDS.items():
        if not set_by_user.contains(key):
            spark.conf.set(key, value)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, without a trailing slash."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="rasterloom-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table from rows of the driver, by Arrow: rows as Python objects would need Python workers on the executors."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kinds)
    columns = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), kinds)


def give_back(spark: SparkSession) -> None:
    """Have the executors return heap that an earlier stage made them take: a full collection lets the JVM shrink it.

    Worth a second between stages of a pipeline that share executors with Python workers; it changes no result.
    """
    n = 4 * spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).selectExpr("java_method('java.lang.System', 'gc')").write.format("noop").mode("overwrite").save()


def few_files(df: DataFrame, rows: int, per_file: int) -> DataFrame:
    """``df``, which has about ``rows`` rows at most, in no more partitions than that many rows need: small tables become few files.

    A stage that counts within its partition must come after this, not before: joined partitions run it once each, under one number.
    """
    return df.coalesce(max(1, -(-rows // per_file)))


def stored(spark: SparkSession, df: DataFrame, label: str, rows: int | None = None, per_file: int = 100_000, **options) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    A lost executor costs a re-read of this table, never a recomputation of
    what led to it. rows: how many there are at most, about, where that is known, for
    :func:`few_files`. ``options`` go to the writer. The path is new on each call;
    :func:`drop_stored` removes it.
    """
    bound_batches(spark)
    df = df if rows is None else few_files(df, rows, per_file)
    path = f"{shared_dir(spark)}/rasterloom/{label}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def drop_stored(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table of :func:`stored` that no later step reads."""
    path = getattr(df, "_stored_path", None)
    if path:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
