"""callwright: function-call corpus work expressed as Spark DataFrame jobs.

Sub-packages:
  functions  Column builders (JSON checks, argument dialects, tag extraction, normaliser)
  operators  DataFrame -> DataFrame operators (calls, rules, profile, chat, evaluate, ...)
  sources    readers for rule assets and corpora, and sinks
  plans      named queries over the driver tables (fixtures + operators)
  streaming  the stateless operators applied to streaming DataFrames
"""

__version__ = "0.1.0"


def _pickle_udfs_by_value() -> None:
    """Ship the pandas UDF bodies inside the task closures, so executors need no copy of this
    package on their path (no --py-files step on a cluster)."""
    import sys

    try:
        from pyspark import cloudpickle

        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # older pyspark: fall back to shipping the package with --py-files
        pass


_pickle_udfs_by_value()
