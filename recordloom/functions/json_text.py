"""JSON texts without blanks, or with them."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def minified(text: Column) -> Column:
    """A JSON text without white space between its parts; broken JSON is an error, null stays null."""
    return F.to_json(F.parse_json(text))


@F.pandas_udf(StringType())
def _indented(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: json.dumps(json.loads(x), ensure_ascii=False, indent=2), na_action="ignore")


def prettified(text: Column) -> Column:
    """A JSON text with a line for each part; broken JSON is an error, null stays null. Spark has no such function, so batches go through Python."""
    return _indented(text)
