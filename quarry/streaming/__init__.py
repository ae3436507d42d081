"""Conditions over unbounded frames.

The request language has no windows or state, so what streams is what needs none: where and select.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..engine import Query
from ..model import ConditionGroup
from ..sources import Catalog, Entity


def filtered_stream(stream: DataFrame, group: ConditionGroup | dict | str, selects: list[str] | None = None) -> DataFrame:
    """A stream's rows under a condition group, projected; both stay in the stream's own plan."""
    if not stream.isStreaming:
        raise ValueError("not a streaming DataFrame")
    query = Query(Catalog(), Entity("Stream", stream))
    kept = query.where(ConditionGroup.from_json(group))
    return kept.select(selects) if selects else kept.df
