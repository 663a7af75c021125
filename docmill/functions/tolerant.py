"""JSON objects in free text. Brace matching is sequential, so this is an Arrow-batched function."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def balanced(text: str | None) -> str | None:
    """The first object of the text that parses, or None; braces in string literals don't count."""
    if not text:
        return None
    reader, at = json.JSONDecoder(), text.find("{")
    while at >= 0:
        try:
            found, _ = reader.raw_decode(text, at)
            return json.dumps(found, ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            at = text.find("{", at + 1)
    return None


@F.pandas_udf(T.StringType())
def first_object(replies: pd.Series) -> pd.Series:
    return replies.map(balanced)
