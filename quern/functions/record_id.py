"""Record ids from weighted fields."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.config import RecordField

DEFAULT_FIELDS = (RecordField("message"), RecordField("log.level"))


def normalized(simple: Sequence[str] = (), weighted: Sequence[RecordField] = ()) -> tuple[RecordField, ...]:
    """Weighted fields win over simple ones, no field at all means the defaults; weight 0 is 1."""
    chosen = tuple(weighted) or tuple(RecordField(f) for f in simple) or DEFAULT_FIELDS
    return tuple(RecordField(f.field, f.weight or 1.0, f.required, f.default) for f in chosen)


def record_id(fields: Sequence[RecordField], resolve: Callable[[str], Column], surrogate: Column) -> Column:
    """Equal weights: values sorted and joined with ``:``; else by weight (highest first, then
    by name), each as often as its weight rounded up. Empty values count as absent. Where a
    required field is absent, or all are, ``surrogate`` identifies the record."""
    value = lambda f: F.coalesce(F.nullif(resolve(f.field), F.lit("")), F.lit(f.default).cast("string"))
    if len({f.weight for f in fields}) <= 1:
        parts = F.array_sort(F.array_compact(F.array(*map(value, fields))))
    else:
        ordered = sorted(fields, key=lambda f: (-f.weight, f.field))
        parts = F.array_compact(F.flatten(F.array(*[F.array_repeat(value(f), math.ceil(f.weight)) for f in ordered])))
    bad = F.size(parts) == 0
    for f in fields:
        if f.required:
            bad = bad | value(f).isNull()
    return F.when(bad, surrogate).otherwise(F.array_join(parts, ":"))
