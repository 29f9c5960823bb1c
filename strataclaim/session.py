"""Session helpers shared by all operators: lineage cuts, checked broadcasts, table access."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows up to which a side may be broadcast once they were counted.
BROADCAST_ROWS = 200_000
#: Bytes of these rows up to which it may be.
BROADCAST_BYTES = 64 * 2**20


def build_session(cores: str = "*", app: str = "strataclaim", **conf: str) -> SparkSession:
    """A local session with the settings every operator expects (UTC, adaptive execution, Arrow)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        "spark.driver.host": "127.0.0.1",
    } | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def _find_package(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it, whatever their folder."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[1])
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([*known, root])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    _find_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder all executors share.

    It is the one the session names in ``spark.checkpoint.dir`` (or has set already). Only a local
    session without one gets a temporary folder; a cluster session without one is an error.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not path:
        if not (sc.master or "").startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="strataclaim-checkpoint-")
    sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_WRITTEN: list[tuple[SparkSession, str]] = []


def write_cut(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table written to the shared folder and read again.

    For results that are read more than once and column by column. The tables stay until
    ``drop_cuts``, as lazily built results may still read them.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_cuts() -> None:
    """Remove every table that ``write_cut`` has written so far."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _width(df: DataFrame) -> Column:
    """Bytes of a row, about: text and binary by their length, nested values by their JSON, all else 8."""
    total = F.lit(8)
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            total = total + 8 + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
        else:
            total = total + 8
    return total


def broadcast_checked(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows and ``max_bytes`` bytes, else as it is.

    The check reads at most ``max_rows + 1`` rows to a decision; call it on cheap or checkpointed
    inputs.
    """
    rows, size = df.select(_width(df).alias("w")).limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum("w")).first()
    small = rows <= max_rows and (size or 0) <= max_bytes
    return (F.broadcast(df) if small else df), small
