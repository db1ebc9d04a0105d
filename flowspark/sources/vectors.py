"""Metadata of vector tables; ``collection.Collection`` keeps the tables themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.operators.cleaning import name


def flat_metadata(df: DataFrame, metadata: str = "metadata", title: str = "title", source: str = "source") -> Column:
    """Map of plain texts: scalars as they are, lists joined, anything else dropped; title and source added."""
    entries = {c: F.coalesce(name(c), F.lit("")) for c in (title, source)}
    for field in df.schema[metadata].dataType.fields:
        value = F.col(f"{metadata}.`{field.name}`")
        if isinstance(field.dataType, (T.StructType, T.MapType)):
            continue
        if isinstance(field.dataType, T.ArrayType):
            value = F.array_join(F.transform(value, lambda x: x.cast("string")), ", ")
        text = value.cast("string")
        entries[field.name] = F.coalesce(text, entries[field.name]) if field.name in entries else text
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in entries.items()])
    return F.map_from_entries(F.filter(pairs, lambda pair: pair["value"].isNotNull()))
