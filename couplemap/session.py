"""Session helpers: a local session for tests and bench, and the shared
checkpoint folder used by the iterative operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every session of this library wants; on a cluster they come from
# spark-defaults, locally from ``local_session``.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int = 8, shuffle_partitions: int = 8, app: str = "couplemap") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
    )
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``couplemap`` importable by the Python workers (pandas UDFs run
    there): zip the package once per application and add it with
    ``addPyFile``, which Spark distributes to every executor."""
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    base = os.path.dirname(pkg)
    archive = os.path.join(tempfile.mkdtemp(prefix="couplemap-code-"), "couplemap.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(pkg):
            if "__pycache__" in folder:
                continue
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, base))
    sc.addPyFile(archive)
    _SHIPPED.add(key)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder must be shared storage configured by the
    operator, so an unset value there is an error.  Only a local-mode
    session (tests, bench) gets a fresh scratch folder of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    conf = sc.getConf().get("spark.checkpoint.dir", None)
    if conf:
        sc.setCheckpointDir(conf)
        return conf
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: iterative operators need a shared "
            "checkpoint folder on a cluster"
        )
    folder = tempfile.mkdtemp(prefix="couplemap-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(folder)
    return folder


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a parquet table in the shared checkpoint folder.

    Survives executor loss, keeps the plan of iterative loops short, and
    (unlike ``DataFrame.checkpoint``, which carries the optimizer's size
    estimate of the old plan along) starts from the real file sizes, so
    estimates do not compound from round to round.

    The shuffle files of the write go with it (iterative operators would
    gather those of all rounds): nothing else reads them, as every run of a
    query plans its shuffles anew."""
    spark = df.sparkSession
    folder = ensure_checkpoint_dir(spark).rstrip("/")
    target = f"{folder}/tables/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    if before is None:  # a Spark without the setting
        df.write.mode("overwrite").parquet(target)
        return spark.read.parquet(target)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(target)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.parquet(target)
