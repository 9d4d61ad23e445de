"""Objects of a dataclass, kept as JSON in a collection of their own."""

from __future__ import annotations

import dataclasses
import json
import typing

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .version_store import KeyNotFound, VersionStore

TYPES = {int: T.LongType(), float: T.DoubleType(), bool: T.BooleanType(), str: T.StringType(), bytes: T.BinaryType()}


def collection_name(model: type) -> str:
    return model.__name__.lower() + "s"


def spark_type(hint: object) -> T.DataType:
    if hint in TYPES:
        return TYPES[hint]
    origin, args = typing.get_origin(hint), [a for a in typing.get_args(hint) if a is not type(None)]
    if origin is list:
        return T.ArrayType(spark_type(args[0]))
    if origin is dict:
        return T.MapType(T.StringType(), spark_type(args[1]))
    if dataclasses.is_dataclass(hint):
        return struct_of(hint)
    if len(args) == 1:
        return spark_type(args[0])
    raise TypeError(f"no column type for {hint}")


def struct_of(model: type) -> T.StructType:
    hints = typing.get_type_hints(model)
    return T.StructType([T.StructField(f.name, spark_type(hints[f.name])) for f in dataclasses.fields(model)])


def parsed_model(model: object) -> tuple[int, str, str]:
    """(id, collection, JSON) of an object."""
    if not dataclasses.is_dataclass(model) or isinstance(model, type):
        raise TypeError("provided model payload must be a dataclass instance")
    if not hasattr(model, "id"):
        raise TypeError("target model must contain a public 'id' field")
    if not isinstance(model.id, int) or isinstance(model.id, bool) or model.id < 0:
        raise TypeError("the model 'id' field must be an unsigned integer")
    try:
        return model.id, collection_name(type(model)), json.dumps(dataclasses.asdict(model))
    except TypeError as e:
        raise TypeError(f"failed to serialize model properties to JSON: {e}") from e


class Objects:
    """Insert, find, update and delete single objects; frame() gives all of a class as typed columns."""

    def __init__(self, store: VersionStore):
        self.store = store

    def _put(self, model: object) -> None:
        key, collection, text = parsed_model(model)
        self.store.write(collection, self.store.spark.createDataFrame([(str(key), text)], "key string, value string"))

    insert = update = _put

    def find(self, model: type, key: int):
        try:
            text = self.store.read(collection_name(model), str(key))
        except KeyNotFound as e:
            raise KeyNotFound(f"record query failed: {e.args[0]}") from e
        return model(**json.loads(text))

    def delete(self, model: object) -> None:
        key, collection, _ = parsed_model(model)
        self.store.delete(collection, self.store.spark.createDataFrame([(str(key),)], "key string"))

    def frame(self, model: type) -> DataFrame:
        return from_json_rows(self.store.live(collection_name(model)), struct_of(model))


def from_json_rows(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Typed columns of (value)."""
    return rows.select(F.from_json("value", schema).alias("o")).select("o.*")


def to_json_rows(frame: DataFrame, key: str) -> DataFrame:
    """(key, value): each row as JSON."""
    return frame.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*frame.columns)).alias("value"))
