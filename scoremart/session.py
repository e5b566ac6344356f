"""Session set-up and staging of intermediate tables on shared storage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FALLBACK: dict[str, str] = {}


def build_session(app: str = "scoremart", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is tuned for; cluster settings win when given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # Result files are 50-500 KB: a low open cost packs many of them into one task.
        "spark.sql.files.openCostInBytes": str(256 * 1024),
        **conf,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster in ``spark.checkpoint.dir``.

    A session on one machine may do without that setting and gets a temporary folder; on a
    cluster its absence is an error, because other machines would not see such a folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FALLBACK:
        _LOCAL_FALLBACK[app] = tempfile.mkdtemp(prefix="scoremart-")
    return _LOCAL_FALLBACK[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused path below the shared folder."""
    return f"{shared_dir(spark)}/scoremart/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet on shared storage and read it back, with ``by`` one directory per value of that column.

    Cuts the lineage like a checkpoint, survives lost executors, and keeps column pruning
    and filter push-down for the readers, which a checkpoint of whole rows would not.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def path_missing(error: Exception) -> bool:
    """Whether an analysis error only says that the path to read does not exist."""
    condition = getattr(error, "getCondition", lambda: None)()
    return condition == "PATH_NOT_FOUND"
