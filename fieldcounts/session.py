"""Session helpers.

Library code never builds its own session: every operator takes DataFrames
and returns a DataFrame.  These helpers are for tests, the bench and the
driver entry point.  On a cluster the session (and ``spark.checkpoint.dir``)
comes from the platform; we only fill settings that are unset.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings a local test/bench session gets when nothing else set them.
LOCAL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, shuffle_partitions: int | None = None,
                  app: str = "fieldcounts") -> SparkSession:
    """A local[N] session for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in LOCAL_DEFAULTS.items():
        builder = builder.config(k, v)
    parts = shuffle_partitions or (int(cores) if str(cores).isdigit() else 8)
    builder = (builder.config("spark.sql.shuffle.partitions", str(parts))
               .config("spark.driver.memory", os.environ.get("FIELDCOUNTS_DRIVER_MEM", "16g")))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the session names.

    On a cluster ``spark.checkpoint.dir`` must name shared storage; without it
    this fails, because a folder of our own choosing would lie on one machine.
    Only a ``local[...]`` session (tests, local bench), whose driver and
    executors are one process, gets a fresh scratch folder instead.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not current:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="fieldcounts-ckpt-")
        sc.setCheckpointDir(current)
        try:
            spark.conf.set("spark.checkpoint.dir", current)
        except Exception:  # noqa: BLE001 - some sessions refuse core settings at run time
            pass
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/fieldcounts/{name}-{uuid.uuid4().hex}"
