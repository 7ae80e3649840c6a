"""Runtime parameters by owner and key, on the driver; the next batch sees a change."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Tunable:
    """Named values with limits; unknown keys read as 0."""

    def __init__(self, ident: str, values: dict[str, float], limits: dict[str, Callable[[float], float]] | None = None):
        self.ident, self._values, self._limits = ident, dict(values), limits or {}

    def set(self, key: str, value: float) -> None:
        self._values[key] = self._limits.get(key, lambda x: x)(float(value))

    def get(self, key: str) -> float:
        return self._values.get(key, 0.0)

    def items(self):
        return self._values.items()


class TunableRegistry:
    def __init__(self):
        self._all: dict[str, Tunable] = {}

    def register(self, tunable: Tunable) -> None:
        """The last one of an id counts."""
        self._all[tunable.ident] = tunable

    def lookup(self, ident: str) -> tuple[Tunable | None, bool]:
        return self._all.get(ident), ident in self._all

    def set_value(self, ident: str, key: str, value: float) -> bool:
        if ident not in self._all:
            return False
        self._all[ident].set(key, value)
        return True

    def get_value(self, ident: str, key: str) -> tuple[float, bool]:
        return (self._all[ident].get(key), True) if ident in self._all else (0.0, False)

    def list(self, spark: SparkSession) -> DataFrame:
        rows = [(t.ident, k, float(v)) for t in self._all.values() for k, v in t.items()]
        return spark.createDataFrame(rows, "id string, key string, value double")
