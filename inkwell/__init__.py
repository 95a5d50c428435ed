"""inkwell: data-journalism analyses as plain Spark DataFrame jobs.

Every job is a function ``DataFrame(s) -> DataFrame`` built on the DataFrame /
SQL API, so Catalyst prunes columns, pushes filters into the parquet scans and
plans shuffles; nothing is collected to the driver.
"""

import sys

from pyspark import cloudpickle as _cloudpickle

# Python code that runs inside tasks (the classifier in mapInPandas) is
# serialized by value, so executors need no copy of this package.
_cloudpickle.register_pickle_by_value(sys.modules[__name__])

from inkwell.session import get_spark, scratch_path  # noqa: E402

__all__ = ["get_spark", "scratch_path"]
