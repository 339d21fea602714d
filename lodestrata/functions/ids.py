"""Entity ids, topic paths and hashes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def entity_id(ns: Column, local: Column) -> Column:
    """``ns:local``; null if either is null."""
    return F.concat(ns, F.lit(":"), local)


def parse_entity_id(text: Column) -> Column:
    """``ns, local`` of ``ns:local``, split at the first colon; null without one."""
    return F.when(F.contains(text, F.lit(":")), F.struct(F.regexp_extract(text, r"(?s)^([^:]*):(.*)$", 1).alias("ns"), F.regexp_extract(text, r"(?s)^([^:]*):(.*)$", 2).alias("local")))


def topic_path(components: Column) -> Column:
    """The components joined by dots."""
    return F.array_join(components, ".")


def topic_parent(path: Column) -> Column:
    """The path without its last component; null for a single one."""
    return F.when(F.contains(path, F.lit(".")), F.regexp_replace(path, r"\.[^.]*$", ""))


def bucket_of(key: Column, buckets: int) -> Column:
    """A stable bucket of a key, 0 to ``buckets`` - 1, for sampling and rollouts."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
