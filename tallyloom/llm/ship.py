"""Making a session ready for the operators of this subpackage."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


#: Rows of an Arrow batch. Rows hold whole texts here, so Spark's default would keep tens of MB per batch on either side of
#: each Python worker. A session that was given another number than the default keeps it.
BATCH_ROWS, SPARK_BATCH_ROWS = 500, "10000"
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, for sessions that were not started with it; set the batch
    size of text rows."""
    context = spark.sparkContext
    if spark.conf.get(_BATCH_SETTING, SPARK_BATCH_ROWS) == SPARK_BATCH_ROWS:
        spark.conf.set(_BATCH_SETTING, BATCH_ROWS)
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        name = os.path.join(tempfile.mkdtemp(), "tallyloom")
        context.addPyFile(shutil.make_archive(name, "zip", top, "tallyloom"))
