"""Row-wise operators on arriving files.

The expressions of ``captrellis.functions`` and the sample builder keep no state,
so they run unchanged on ``readStream``; only the sink differs.
"""

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def append_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append all files that have arrived to a Parquet table, then stop; a restart resumes from ``checkpoint``."""
    return (
        df.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(path)
    )
