"""Options of a writer: a bag with defaults that never loses what the caller set."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, DataFrameWriter


class Options:
    """Names and values; ``default`` sets only what isn't set."""

    def __init__(self, **values: Any):
        self._values = dict(values)

    def get(self, name: str, otherwise: Any = None) -> Any:
        return self._values.get(name, otherwise)

    def set(self, name: str, value: Any) -> Options:
        self._values[name] = value
        return self

    def update(self, **values: Any) -> Options:
        self._values |= values
        return self

    def default(self, name: str, value: Any) -> Any:
        return self._values.setdefault(name, value)

    def writer(self, rows: DataFrame) -> DataFrameWriter:
        """Spark's writer of ``rows`` with these options, those without a value left out."""
        return rows.write.options(**{k: v for k, v in self._values.items() if v is not None})
