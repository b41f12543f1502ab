"""Session set-up and the one place where lineage is cut."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import inspect
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every plan in this package counts on. Row-to-lookup joins carry the rows on the
# left and one row per key on the right, so the skew-join rule can split a hot key's partition;
# forcing it keeps that true below an aggregate as well.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


_SHIPPED: set[str] = set()

# Bytes of one batch of rows on its way to a Python worker, unless the session names its own: both processes hold whole
# batches beside the heap, and with long texts Spark's limit of 10,000 rows bounds nothing.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def ship(spark: SparkSession) -> None:
    """Send this package to the workers once per application, so that they need no copy of the folder.

    The archive is a file for Spark's own file server on the driver; no task reads a local folder. Batches that the
    session sends to workers are bounded, too.
    """
    sc = spark.sparkContext
    if spark.conf.get(BATCH_BYTES[0], None) is None:
        spark.conf.set(*BATCH_BYTES)
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="schemaloom-")) / "schemaloom.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)


def release() -> None:
    """Give freed memory of this process back to the machine: Arrow's pool, and the C library's (where it can)."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def lean(run):
    """A task function, of batches or of one group, whose worker keeps no freed memory when it is done.

    Workers live on beside the heap from task to task and from stage to stage, and an executor's memory is shared.
    """
    if inspect.isgeneratorfunction(run):
        def leaner(batches):
            yield from run(batches)
            release()
    else:
        def leaner(frame):
            out = run(frame)
            release()
            return out
    return functools.update_wrapper(leaner, run, ("__name__", "__doc__"), ())


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str | int = "*", app: str = "schemaloom", **conf) -> SparkSession:
    """A local session for tests and the benchmark; a cluster passes its own session in."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a temporary one in local mode only."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="schemaloom-"))
    return sc.getCheckpointDir().rstrip("/")


# Whether Spark drops the shuffle files of a query as it ends, not when the driver happens to collect its garbage.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def dropped_shuffles(spark: SparkSession):
    """Queries begun herein leave no shuffle files; for those whose plans are not run again."""
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(DROP_SHUFFLES, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from there (survives lost executors).

    A columnar table and not a row checkpoint: readers take only their columns, and the size of the
    files tells the planner which joins may broadcast. The write's own shuffle files go as it ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    with dropped_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(table: DataFrame) -> DataFrame:
    """Deal the rows of a scan out to all cores when its files give fewer tasks than that.

    For work that is heavy per row (text parsing) on few or unsplittable files; a large input already
    comes in more pieces and is left as it is. Only for plain scans: counting the pieces must not
    run anything.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores)
