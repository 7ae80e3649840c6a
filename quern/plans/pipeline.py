"""Pipelines as ordered steps, with the wiring rules they must obey."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

#: Steps that must come before others where both appear.
BEFORE = (("memory_limit", "*"), ("metadata", "upsert"), ("upsert", "pii"), ("pii", "head_sample"), ("head_sample", "reservoir"), ("enrich", "normalize"), ("normalize", "topn"), ("topn", "drop_pid"), ("reservoir", "batch"), ("drop_pid", "batch"), ("batch", "route"))


def check_order(names: list[str]) -> list[str]:
    """The broken rules, as text."""
    place = {n: i for i, n in enumerate(names)}
    broken = [f"{a} must come before {b}" for a, b in BEFORE if b != "*" and a in place and b in place and place[a] > place[b]]
    return broken + [f"{a} must come first" for a, b in BEFORE if b == "*" and place.get(a, 0) > 0]


class Pipeline:
    def __init__(self, steps: list[tuple[str, Callable[[DataFrame], DataFrame]]]):
        if broken := check_order([n for n, _ in steps]):
            raise ValueError("; ".join(broken))
        self.steps = steps

    def __call__(self, df: DataFrame) -> DataFrame:
        for _, step in self.steps:
            df = df.transform(step)
        return df
