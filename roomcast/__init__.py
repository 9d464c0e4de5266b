"""roomcast: Spark-native fingerprint localization and route analytics.

Every operator is a function from DataFrames to a DataFrame.  Relational work
is plain DataFrame/SQL code; the only Python executed inside tasks is the
numpy distance kernel of the block kNN join and the stateful streaming
session function.
"""

from roomcast.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
