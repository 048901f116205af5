"""Content hashes, sources and whether a document has changed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnwood.model import RESERVED

SOURCE_FIELDS = ("kind", "uri", "external_id", "version", "etag", "revision", "observed_at_unix_ms", "title")


def canonical(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def content_hash(text: Column) -> Column:
    """SHA-256 of the text with line ends made LF."""
    return F.sha2(F.encode(canonical(text), "UTF-8"), 256)


def change(old_hash: Column, new_hash: Column, old: list[Column] = (), new: list[Column] = ()) -> Column:
    """new, changed or unchanged, by the hash and by each source field; nulls compare as values."""
    same = old_hash.eqNullSafe(new_hash)
    for a, b in zip(old, new, strict=True):
        same = same & a.eqNullSafe(b)
    return F.when(old_hash.isNull(), "new").when(same, "unchanged").otherwise("changed")


def with_provenance(metadata: Column, text: Column, source: Column | None = None) -> Column:
    """Adds the content hash and source to a map; reserved keys in the input are an error."""
    clash = F.exists(F.map_keys(metadata), lambda k: k.startswith(RESERVED))
    own = F.when(clash, F.raise_error(F.lit("reserved metadata key")).cast("map<string,string>")).otherwise(metadata)
    added = F.create_map(F.lit(f"{RESERVED}content"), content_hash(text))
    if source is not None:
        added = F.map_concat(added, F.create_map(F.lit(f"{RESERVED}source"), F.to_json(source)))
    return F.map_concat(own, added)


def source_timestamp(value: Column) -> Column:
    """A non-negative whole number of milliseconds, else null."""
    n = value.try_cast("double")
    return F.when((n >= 0) & (n == F.floor(n)), n.cast("long"))
