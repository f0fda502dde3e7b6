"""Models: declared properties that map to Spark types, with defaults, validation, relations and a fingerprint."""

from __future__ import annotations

import hashlib
import json
import re
import uuid as _uuid
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

KEY = "uuid"
SCALARS = {"text": T.StringType(), "integer": T.LongType(), "float": T.DoubleType(), "boolean": T.BooleanType(), "date": T.TimestampType(), "json": T.StringType()}


def new_uuid() -> str:
    """32 lowercase hex characters."""
    return _uuid.uuid4().hex


@dataclass(frozen=True)
class Property:
    """kind: text, integer, float, boolean, date, json, array, embedded, scalar, computed or relation."""

    kind: str
    type: T.DataType | None = None
    unique: bool = False
    index: bool = False
    required: bool = False
    default: Any = None
    check: Callable[[Any], bool] | None = None
    compute: Callable[[DataFrame], Column] | None = None
    encode: Callable[[Any], Any] | None = None
    decode: Callable[[Column], Column] | None = None
    target: str | None = None
    many: bool = False
    embed: bool = False
    inverse: str | None = None
    length: int | None = None

    @property
    def stored(self) -> bool:
        return self.kind != "computed"


def text(length: int = 1000, **hints: Any) -> Property:
    return Property("text", SCALARS["text"], length=length, **hints)


def integer(**hints: Any) -> Property:
    return Property("integer", SCALARS["integer"], **hints)


def float_(**hints: Any) -> Property:
    return Property("float", SCALARS["float"], **hints)


def boolean(**hints: Any) -> Property:
    return Property("boolean", SCALARS["boolean"], **hints)


def date(**hints: Any) -> Property:
    return Property("date", SCALARS["date"], **hints)


def json_(**hints: Any) -> Property:
    """Opaque JSON text: dotted paths don't go into it."""
    return Property("json", SCALARS["json"], encode=lambda v: None if v is None else json.dumps(v), **hints)


def array(element: T.DataType | None = None, **hints: Any) -> Property:
    return Property("array", T.ArrayType(element or T.StringType()), **hints)


def embedded(shape: T.DataType | None = None, **hints: Any) -> Property:
    return Property("embedded", shape or T.VariantType(), **hints)


def scalar(type_: T.DataType, encode: Callable | None = None, decode: Callable | None = None, **hints: Any) -> Property:
    return Property("scalar", type_, encode=encode, decode=decode, **hints)


def computed(compute: Callable[[DataFrame], Column]) -> Property:
    """Derived at read: neither stored nor filterable nor sortable."""
    return Property("computed", compute=compute)


def to_one(target: str, embed: T.StructType | None = None, inverse: str | None = None) -> Property:
    return Property("relation", embed or T.StringType(), target=target, embed=embed is not None, inverse=inverse)


def to_many(target: str, embed: T.StructType | None = None, inverse: str | None = None) -> Property:
    return Property("relation", T.ArrayType(embed or T.StringType()), target=target, many=True, embed=embed is not None, inverse=inverse)


@dataclass(frozen=True)
class Index:
    """A declaration only: Spark has no indexes; unique ones are checked when a batch is committed."""

    columns: tuple[str, ...]
    unique: bool = False
    sparse: bool = False
    where: Any = None
    ttl_seconds: int | None = None
    text: bool = False


#: Names reach paths, views and columns.
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


class ValidationError(ValueError):
    pass


@dataclass(frozen=True)
class Model:
    name: str
    properties: Mapping[str, Property]
    key: str = KEY
    timestamps: bool = False
    soft_delete: str | None = None
    indexes: tuple[Index, ...] = field(default_factory=tuple)

    def __post_init__(self):
        props = dict(self.properties)
        if self.timestamps:
            props |= {"createdAt": date(), "updatedAt": date()}
        if self.soft_delete:
            props[self.soft_delete] = date()
        props.setdefault(self.key, text())
        for name in (self.name, *props):
            if not _IDENTIFIER.fullmatch(name):
                raise ValueError(f"{name!r} is no identifier")
        object.__setattr__(self, "properties", props)

    @property
    def stored(self) -> dict[str, Property]:
        return {n: p for n, p in self.properties.items() if p.stored}

    def struct(self) -> T.StructType:
        names = [self.key, *(n for n in self.stored if n != self.key)]
        return T.StructType([T.StructField(n, self.properties[n].type, n != self.key) for n in names])

    def unique_keys(self) -> list[tuple[str, ...]]:
        return [(n,) for n, p in self.properties.items() if p.unique] + [i.columns for i in self.indexes if i.unique]

    def instance(self, data: Mapping[str, Any], now: datetime | None = None) -> dict[str, Any]:
        """A record with defaults for what is absent, stamps and an id, validated."""
        now = now or datetime.now(UTC).replace(tzinfo=None)
        row: dict[str, Any] = {}
        for name, p in self.stored.items():
            value = data[name] if name in data else (p.default() if callable(p.default) else p.default)
            if p.required and value is None:
                raise ValidationError(f"{self.name}.{name} is required")
            if value is not None and not valid(p, value):
                raise ValidationError(f"{self.name}.{name} can't be {value!r}")
            row[name] = p.encode(value) if p.encode and value is not None else value
        if row.get(self.key) in (None, ""):
            if not isinstance(self.properties[self.key].type, T.StringType):
                raise ValidationError(f"{self.name} needs a {self.key}")
            row[self.key] = new_uuid()
        if self.timestamps:
            row["createdAt"] = row["createdAt"] or now
            row["updatedAt"] = now
        return row

    def frame(self, spark: SparkSession, rows: Iterable[Mapping[str, Any]]) -> DataFrame:
        struct = self.struct()
        return spark.createDataFrame([tuple(r[f.name] for f in struct) for r in map(self.instance, rows)], struct)


def valid(p: Property, value: Any) -> bool:
    if p.check is not None and not p.check(value):
        return False
    number = isinstance(value, int | float) and not isinstance(value, bool)
    return {
        "text": lambda: isinstance(value, str),
        "integer": lambda: number and float(value).is_integer(),
        "float": lambda: number and abs(value) != float("inf") and value == value,
        "boolean": lambda: isinstance(value, bool),
        "date": lambda: isinstance(value, datetime),
        "array": lambda: isinstance(value, list | tuple),
    }.get(p.kind, lambda: True)()


def fingerprint(models: Iterable[Model]) -> str:
    """16 hex characters that change with any model's name, key or properties, but not with their order."""
    about = {m.name: {"key": m.key, "properties": {n: [p.kind, p.target, p.many, p.embed, p.unique, p.inverse] for n, p in m.properties.items()}} for m in models}
    return hashlib.sha256(json.dumps(about, sort_keys=True).encode()).hexdigest()[:16]


def renamed(model: Model, **changes: Any) -> Model:
    return replace(model, **changes)


def sequence(start: int = 1) -> Callable[[], int]:
    """A counter for factories."""
    state = {"n": start - 1}

    def step() -> int:
        state["n"] += 1
        return state["n"]

    return step


@dataclass
class Factory:
    """Builds records of a model for tests and seeding; a callable default is called for each record."""

    model: Model
    defaults: Mapping[str, Any]

    def build(self, n: int = 1, **over: Any) -> list[dict[str, Any]]:
        return [self.model.instance({k: v() if callable(v) else v for k, v in (dict(self.defaults) | over).items()}) for _ in range(n)]
