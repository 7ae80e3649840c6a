"""Row transforms of the pipelines: upsert, hashing of personal data, naming, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(attributes: Column, values: dict[str, Column]) -> Column:
    """The map with these keys set; a null value leaves its key as it is."""
    out = attributes
    for key, value in values.items():
        kept = F.map_filter(out, _differs(key))
        out = F.when(value.isNotNull(), F.map_concat(kept, F.create_map(F.lit(key), value))).otherwise(out)
    return out


def _differs(key: str):
    return lambda k, _: k != F.lit(key)


def drop_key(attributes: Column, key: str) -> Column:
    return F.map_filter(attributes, _differs(key))


def hash_pii(value: Column, salt: str) -> Column:
    """Hex SHA-256 of salt and value; null and empty stay."""
    return F.when(value != "", F.sha2(F.concat(F.lit(salt), value), 256)).otherwise(value)


def attach_metadata(rows: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """Metadata columns by key; rows without an entry get nulls."""
    return rows.join(metadata, key, "left")


def display_name(exe: Column, cmdline: Column) -> Column:
    """``exe first-50-characters``; for java with -jar the jar. Null where either is absent."""
    plain = F.when((exe != "") & (cmdline != ""), F.concat(exe, F.lit(" "), F.substring(cmdline, 1, 50)))
    jar = F.regexp_replace(cmdline, r"^.*-jar\s+([^\s]+).*$", "java -jar $1")
    return F.when((exe == "java") & cmdline.rlike(r"-jar\s+[^\s]+"), jar).otherwise(plain)


def process_group(owner: Column) -> Column:
    return F.when(owner != "", owner)


def tenant(value: Column, default: str = "default") -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))
