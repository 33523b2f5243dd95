"""Column-level helpers built on ``pyspark.sql.functions`` (no Python UDFs)."""

from autokpi.functions.core import (  # noqa: F401
    display_label,
    fmt2,
    lenient_date,
    lenient_double,
    lenient_timestamp,
    round_half_up,
    title_label,
)
from autokpi.functions.ids import content_ids, positional_index  # noqa: F401
