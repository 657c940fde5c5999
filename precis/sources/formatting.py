"""Python ``%f`` formatting of doubles in an Arrow-batched UDF.

Spark's ``format_string('%f')`` rounds half-up on the decimal expansion while
Python rounds the exact binary value; CSV reports must match Python's bytes.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def format_f(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None or pd.isna(v) else "%f" % v)
