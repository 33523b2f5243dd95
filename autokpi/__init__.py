"""autokpi: automated KPI analytics on Spark DataFrames.

Every operator takes and returns DataFrames, is lazy, and is built from
built-in Spark SQL functions (no Python UDFs).  See README.md for the operator
inventory.
"""

from autokpi.session import get_spark  # noqa: F401

__all__ = ["get_spark"]
