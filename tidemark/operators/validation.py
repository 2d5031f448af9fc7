"""Envelopes and schemas: building events, dispatch by event type, and the split of valid rows from dead letters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.pipeline import Router

GENERIC = "GenericEvent"
BASE = "BaseEvent"

ENVELOPE = T.StructType(
    [
        T.StructField("event_id", T.StringType(), False),
        T.StructField("event_type", T.StringType(), False),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("payload", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.StringType()),
    ]
)


def envelope(df: DataFrame, event_id: Column, timestamp: Column, payload: Column, event_type: Column | None = None, default_type: str = GENERIC) -> DataFrame:
    """Rows as events; a missing type is the default (the name of the sender's model, or GenericEvent)."""
    kind = F.lit(None).cast("string") if event_type is None else event_type
    return df.select(
        F.coalesce(event_id.cast("string"), F.uuid()).alias("event_id"), F.coalesce(kind, F.lit(default_type)).alias("event_type"), timestamp.alias("timestamp"), payload.alias("payload"),
        F.lit(None).cast("int").alias("partition"), F.lit(None).cast("string").alias("offset"),
    )


def with_offset(events: DataFrame, msg_id: Column) -> DataFrame:
    """Events with their message's id as ``offset``."""
    return events.withColumn("offset", msg_id.cast("string"))


@dataclass
class Schema:
    """A declared payload: its type, and rules that its fields must meet (columns over ``body``)."""

    type: T.StructType
    rules: dict[str, Column] = field(default_factory=dict)
    #: Values of fields that older events lack, and earlier names of fields.
    defaults: dict[str, Column] = field(default_factory=dict)
    aliases: dict[str, str] = field(default_factory=dict)


class SchemaRegistry:
    """Schemas by event type; a type that isn't registered falls back to the base envelope, its fields kept as they are."""

    def __init__(self) -> None:
        self.schemas: dict[str, Schema] = {}

    def register(self, event_type: str, schema: Schema) -> None:
        self.schemas[event_type] = schema

    def get(self, event_type: str) -> Schema | None:
        return self.schemas.get(event_type)

    def model(self, event_type: Column) -> Column:
        """Name of the schema that a type is read with."""
        out = F.when(F.lit(False), F.lit(BASE))
        for name in self.schemas:
            out = out.when(event_type == name, F.lit(name))
        return out.otherwise(F.lit(BASE))

    def router(self, event_type: Column, prefix: str = "") -> Router:
        router = Router(default=prefix + BASE)
        for name in self.schemas:
            router.add_route(event_type == name, prefix + name)
        return router


def decode(df: DataFrame, text: str, schema: Schema, name: str = "body") -> DataFrame:
    """JSON text as a struct: earlier names and defaults applied; a text that can't be read gives a null struct."""
    fields = {f.name: f for f in schema.type.fields}
    old = T.StructType([*schema.type.fields, *[T.StructField(a, fields[n].dataType) for n, a in schema.aliases.items()]])
    raw = F.from_json(text, old, {"mode": "PERMISSIVE"})

    def value(n: str) -> Column:
        out = [raw[n], *([raw[schema.aliases[n]]] if n in schema.aliases else []), *([schema.defaults[n]] if n in schema.defaults else [])]
        return F.coalesce(*out).alias(n)

    readable = F.try_parse_json(text).isNotNull()
    return df.withColumn(name, F.when(readable, F.struct(*[value(n) for n in fields])))


def error_of(checks: dict[str, Column]) -> Column:
    """The first check that a row fails (a null counts as failing), or null."""
    out = F.when(F.lit(False), F.lit(""))
    for name, passed in checks.items():
        out = out.when(~F.coalesce(passed, F.lit(False)), F.lit(name))
    return out


def validate_split(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass, rows that don't with ``_error``), from one expression evaluated per row."""
    marked = df.withColumn("_error", error_of(checks))
    return marked.where(F.col("_error").isNull()).drop("_error"), marked.where(F.col("_error").isNotNull())


def compatible(old: T.StructType, new: T.StructType) -> bool:
    """A new schema must have every field of the old one with its type, so that old readers keep working."""
    now = {f.name: f.dataType for f in new.fields}
    return all(now.get(f.name) == f.dataType for f in old.fields)
