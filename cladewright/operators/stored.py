"""Tables kept in the shared checkpoint folder: what several steps read is made once, not once for each of them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """df written as compressed columns beside the session's checkpoints and read back, so that readers take what they need.

    Unlike rows of checkpoint() they are small, and a reader of few columns reads only those. The table stays as long as
    the checkpoints do, as lazy results may still read it.
    """
    spark = df.sparkSession
    folder = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not folder.isDefined():
        raise ValueError("the session has no checkpoint folder")
    path = f"{folder.get()}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
