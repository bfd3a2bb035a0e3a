"""Folders for intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

SHARED_DIR = "spark.checkpoint.dir"


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the cluster's shared directory.

    Only a local session without that setting, as in tests, falls back to a temporary folder, which
    goes when the program ends.
    """
    base = spark.conf.get(SHARED_DIR, None) or spark.sparkContext.getConf().get(SHARED_DIR)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set {SHARED_DIR} to a folder that every executor can reach")
        base = tempfile.mkdtemp(prefix="cargoledger-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
