"""The call operators are column expressions, so they run unchanged on a streaming DataFrame.

The reference has no streaming or stateful operator (SURVEY 2.11); what carries over is the
per-row work: tag extraction, argument parsing, rule conversion (a stream-static join with
the broadcast rule table), normalisation, format checks and per-row scoring.  Output goes
to a file sink with a checkpoint in the shared folder named by ``spark.checkpoint.dir``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalise import format_valid, normalise_calls
from ..operators import calls as calls_op
from ..operators import rules as rules_op
from ..session import checkpoint_dir

TAGGED_SCHEMA = "row_id bigint, query string, llm_output string"


def read_tagged_stream(spark: SparkSession, folder: str, schema: str = TAGGED_SCHEMA, max_files: int = 64) -> DataFrame:
    """JSON-lines files arriving in ``folder`` as a stream of tagged rows."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(folder)


def convert_stream(stream: DataFrame, rules: DataFrame, dialect: str = "plain") -> DataFrame:
    """Calls of every arriving row, converted by the first matching rule (J1) and normalised."""
    calls = calls_op.calls_with_args(stream, "llm_output", ("row_id", "query"), dialect=dialect)
    converted = rules_op.convert_calls(calls, rules).drop("args")
    return converted


def check_stream(stream: DataFrame) -> DataFrame:
    """Per-row normalisation and format check."""
    return stream.select("row_id", normalise_calls(F.col("llm_output")).alias("normalised"), format_valid(F.col("llm_output")).alias("valid"))


def start_file_sink(df: DataFrame, path: str, name: str, fmt: str = "parquet", available_now: bool = True):
    """Start the query with its checkpoint under the shared checkpoint folder."""
    ckpt = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/streams/{name}"
    writer = df.writeStream.format(fmt).option("path", path).option("checkpointLocation", ckpt).outputMode("append")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
