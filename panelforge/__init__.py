"""panelforge — panel-data analytics as Spark DataFrame functions.

Every operator is a function ``DataFrame(s) -> DataFrame`` whose column
names are parameters.  Work runs in Spark (Catalyst plans, windows,
aggregations, ``pyspark.ml``); the driver only ever sees fitted
parameters of bounded size (quantiles, k x k moment matrices, centroids).
"""

from panelforge.session import get_spark, checkpoint_dir, Panel  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir", "Panel"]
