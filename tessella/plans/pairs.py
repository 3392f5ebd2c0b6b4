"""Queries stated as SQL, once for both engines or once for each.

``{name}`` stands for a table of the data folder.  Spark gets the table as a
DataFrame parameter, so paths of any store work and scans are pruned as in
any query; DuckDB gets the bare name.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


class Family:
    """A group of queries and their DuckDB statements."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def sql(self, name: str, text: str, duck: str | None = None, **fixed: object) -> None:
        """Register ``text``, and ``duck`` where DuckDB needs other words; ``fixed``: values for ``:name:`` in both."""
        for key, value in fixed.items():
            text = text.replace(f":{key}:", str(value))
            duck = duck and duck.replace(f":{key}:", str(value))
        names = sorted(set(re.findall(r"\{(\w+)\}", text)))
        self.queries[name] = lambda spark, folder: spark.sql(text, **{n: table(spark, folder, n) for n in names})
        self.oracle[name] = re.sub(r"\{(\w+)\}", r"\1", duck or text)

    def add(self, name: str, query: Query, duck: str | None = None) -> None:
        """Register a function, and its DuckDB statement if SQL can say it."""
        self.queries[name] = query
        if duck:
            self.oracle[name] = duck
