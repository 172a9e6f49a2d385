"""Folders that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def work_folder(spark: SparkSession, label: str) -> str:
    """A new folder as a URI, in the one that the session names; a temporary one only within one process."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        given = "file://" + tempfile.mkdtemp(prefix="tessella-")
    return f"{given.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"
