"""Tables that a query writes for itself, in the folder of spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: dict[str, str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; in a temporary one only where a local session names none (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        base = _OWN.setdefault(app, "") or _OWN.__setitem__(app, "file://" + tempfile.mkdtemp(prefix="hashlode-")) or _OWN[app]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
