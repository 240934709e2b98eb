"""Pick up newly landed feed files.

The archive has no live stream: a harvest runs a few times a week over what has arrived since. The file
source keeps track of the files already read, so a run that is repeated after a failure takes the same ones.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def take_new_files(spark: SparkSession, landing: str, schema: str, progress: str,
                   job: Callable[[DataFrame, int], None]) -> None:
    """Run ``job(feed, run_number)`` over the feed files that landed since the last call, then return.

    ``progress`` is a folder on shared storage. All files found go into one run; ``run_number`` is the same
    when a failed run is repeated, so the job can name its output by it and write it anew.
    """
    feed = spark.readStream.schema(schema).json(landing)
    query = feed.writeStream.trigger(availableNow=True).option("checkpointLocation", progress).foreachBatch(job).start()
    query.awaitTermination()


def snapshot_path(folder: str, run_number: int) -> str:
    return os.path.join(folder, f"run-{run_number:08d}")
