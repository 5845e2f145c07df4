"""Session helpers: the settings that every plan relies on, and reliable checkpoints."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the session is given."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidewright")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def pin_utc(spark: SparkSession) -> SparkSession:
    """Timestamps without zone are UTC throughout, so the session must be too."""
    if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``; make a temporary one only in local mode without that setting."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = context.getConf().get("spark.checkpoint.dir", None)
    if shared is None and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tidewright-checkpoint-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder; it survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a table of groups that are sent to all tasks at most.
FEW_ROWS = 100_000


def few(groups: DataFrame) -> DataFrame:
    """A table of groups, written once and counted: marked for broadcast if it has at most ``FEW_ROWS`` rows, else as it is."""
    written = cut_lineage(groups)
    return F.broadcast(written) if written.count() <= FEW_ROWS else written


def ship_package(spark: SparkSession) -> SparkSession:
    """Sends this package to the Python workers, which need not have it on their path; once for each context."""
    context = spark.sparkContext
    if not getattr(context, "_tidewright_shipped", False):
        root = Path(__file__).parent
        path = os.path.join(tempfile.mkdtemp(prefix="tidewright-code-"), "tidewright.zip")
        with zipfile.ZipFile(path, "w") as out:
            for f in sorted(root.rglob("*.py")):
                out.write(f, str(Path(root.name) / f.relative_to(root)))
        context.addPyFile(path)
        context._tidewright_shipped = True  # noqa: SLF001
    return spark
