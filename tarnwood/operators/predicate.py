"""The filter language: a two-valued expression tree over typed columns or VARIANT metadata."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnwood.model import InvalidRequest



@dataclass(frozen=True)
class Leaf:
    op: str  # eq ne lt lte gt gte exists in contains
    path: tuple[str, ...]
    value: object = None


@dataclass(frozen=True)
class Tree:
    op: str  # and or not
    parts: tuple


def parse(wire: dict | str) -> Leaf | Tree:
    """The JSON form {op, path, value | values | predicates | predicate}."""
    if isinstance(wire, str):
        wire = json.loads(wire)
    op = wire.get("op")
    if op in ("and", "or"):
        return Tree(op, tuple(map(parse, wire["predicates"])))
    if op == "not":
        return Tree(op, (parse(wire["predicate"]),))
    if op not in ("eq", "ne", "lt", "lte", "gt", "gte", "exists", "in", "contains"):
        raise InvalidRequest(f"unknown operator {op}")
    path = tuple(wire.get("path") or ())
    if not path or not all(isinstance(p, str) and p for p in path):
        raise InvalidRequest("a path has at least one key, none empty")
    return Leaf(op, path, wire.get("values") if op == "in" else wire.get("value"))


def temporal(existing: Leaf | Tree | None, after: int | None = None, before: int | None = None, path: tuple[str, ...] = ("_tw_source", "observed_at_unix_ms")) -> Leaf | Tree | None:
    """The user's filter and exclusive bounds on the source's time."""
    parts = [p for p in (existing, Leaf("gt", path, after) if after is not None else None, Leaf("lt", path, before) if before is not None else None) if p is not None]
    return None if not parts else parts[0] if len(parts) == 1 else Tree("and", tuple(parts))


class Variant:
    """Metadata in a VARIANT column: type decides before value does."""

    def __init__(self, column: Column):
        self.column = column

    def at(self, path: tuple[str, ...]) -> Column:
        quoted = "".join("['" + p.replace("\\", "\\\\").replace("'", "\\'") + "']" for p in path)
        return F.try_variant_get(self.column, f"${quoted}", "variant")

    def exists(self, path) -> Column:
        return self.at(path).isNotNull()

    @staticmethod
    def _kind(v: Column) -> Column:
        s = F.schema_of_variant(v)
        return F.when(s.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), "number").when(s == "STRING", "string").when(s == "BOOLEAN", "bool").when(s == "VOID", "null").when(s.startswith("ARRAY"), "array").otherwise("object")

    def equal(self, v: Column, value) -> Column:
        kind = self._kind(v)
        if value is None:
            return kind == "null"
        if isinstance(value, bool):
            return (kind == "bool") & (F.try_variant_get(v, "$", "boolean") == F.lit(value))
        if isinstance(value, (int, float)):
            return (kind == "number") & (F.try_variant_get(v, "$", "double") == F.lit(float(value)))
        if isinstance(value, str):
            return (kind == "string") & (F.try_variant_get(v, "$", "string") == F.lit(value))
        want = F.to_json(F.parse_json(F.lit(json.dumps(value, sort_keys=True))))
        return kind.isin("array", "object") & (F.to_json(v) == want)

    def ordered(self, path, value) -> tuple[Column, Column]:
        """(comparable, value): numbers with numbers, strings with strings."""
        v, number = self.at(path), not isinstance(value, str)
        return self._kind(v) == ("number" if number else "string"), F.try_variant_get(v, "$", "double" if number else "string")

    def contains(self, path, value) -> Column:
        items = F.try_variant_get(self.at(path), "$", "array<variant>")
        return F.exists(items, lambda x: F.coalesce(self.equal(x, value), F.lit(False)))


class Typed:
    """Metadata in ordinary columns, which parquet filters reach. A null is a missing key."""

    def __init__(self, columns: dict[str, str]):
        self.columns = columns  # name -> Spark type

    def at(self, path) -> Column:
        name = ".".join(path)
        return F.col(name) if path[0] in self.columns else F.lit(None).cast("string")

    def exists(self, path) -> Column:
        return self.at(path).isNotNull()

    def _fits(self, path, value) -> bool:
        kind = self.columns.get(path[0], "string")
        if isinstance(value, bool):
            return kind == "boolean"
        return kind == "string" if isinstance(value, str) else kind not in ("string", "boolean")

    def equal(self, v: Column, value) -> Column:
        return F.lit(False) if value is None else v == F.lit(value)

    def ordered(self, path, value) -> tuple[Column, Column]:
        return F.lit(self._fits(path, value)), self.at(path)

    def contains(self, path, value) -> Column:
        return F.array_contains(self.at(path), F.lit(value)) if self.columns.get(path[0], "").startswith("array") else F.lit(False)


def lower(p: Leaf | Tree, fields: Variant | Typed) -> Column:
    """A Column that is true or false, never null. A missing path makes every leaf false.
    Ordering across types fails the query, unless an earlier operand of `and` or `or`
    decides first: both become CASE chains, whose order Spark keeps. Where no operand can
    fail, plain AND and OR are used, so that filters are pushed down."""
    if isinstance(p, Tree):
        parts = [lower(x, fields) for x in p.parts]
        if p.op == "not":
            return ~parts[0]
        if not _may_fail(p, fields):
            out = F.lit(p.op == "and")
            for x in parts:
                out = (out & x) if p.op == "and" else (out | x)
            return out
        out = F.lit(p.op == "and")
        for x in reversed(parts):
            out = F.when(~x, F.lit(False)).otherwise(out) if p.op == "and" else F.when(x, F.lit(True)).otherwise(out)
        return out
    at = fields.at(p.path)
    if p.op == "exists":
        return fields.exists(p.path)
    if p.op == "eq":
        value = fields.equal(at, p.value) if not isinstance(fields, Typed) or fields._fits(p.path, p.value) else F.lit(False)
    elif p.op == "ne":
        value = fields.exists(p.path) & ~F.coalesce(fields.equal(at, p.value), F.lit(False))
    elif p.op == "in":
        value = F.lit(False)
        for v in p.value or ():
            value = value | F.coalesce(fields.equal(at, v), F.lit(False))
    elif p.op == "contains":
        value = fields.contains(p.path, p.value)
    else:
        if isinstance(p.value, (bool, list, dict)) or p.value is None:
            comparable, left = F.lit(False), F.lit(None).cast("double")
            right = F.lit(None).cast("double")
        else:
            comparable, left = fields.ordered(p.path, p.value)
            right = F.lit(p.value if isinstance(p.value, str) else float(p.value)) if isinstance(fields, Variant) else F.lit(p.value)
        test = {"lt": left < right, "lte": left <= right, "gt": left > right, "gte": left >= right}[p.op]
        if isinstance(fields, Typed) and fields._fits(p.path, p.value):
            value = test
        else:
            value = F.when(fields.exists(p.path), F.when(comparable, test).otherwise(F.raise_error(F.lit("ordering comparison between types")).cast("boolean")))
    return F.coalesce(value, F.lit(False))


def _may_fail(p, fields) -> bool:
    if isinstance(p, Tree):
        return any(_may_fail(x, fields) for x in p.parts)
    return p.op in ("lt", "lte", "gt", "gte") and not (isinstance(fields, Typed) and fields._fits(p.path, p.value))


def project(metadata: Column, keys: list[str] | None = None, include_provenance: bool = False) -> Column:
    """Of a map of metadata: without reserved keys, then the keys asked for (empty: all)."""
    out = metadata if include_provenance else F.map_filter(metadata, lambda k, v: ~k.startswith("_tw_"))
    return F.map_filter(out, lambda k, v: k.isin(*keys)) if keys else out
