"""Scalar functions as Column expressions; all stay inside the JVM and most inside code generation."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the data model.
SLICES = 1024
SEPARATOR = "|"
TOPIC_PREFIX = "t:"
EARTH_RADIUS_M = 6_371_000


#: Characters up to which a string's hash is a sum without a loop, each of so many terms.
SHORT = (16, 32)


def _short_hash(text: Column, size: int) -> Column:
    """The hash of at most `size` ASCII characters, compiled with its query: bytes from the last one on; before the first one there is none, which counts 0."""
    code = lambda i: F.ascii(F.substring(text.cast("binary"), -i, 1).cast("string")).cast("long")
    return reduce(Column.__add__, (code(i) * pow(31, i - 1, 1 << 32) for i in range(1, size + 1)))


def string_hash(text: Column) -> Column:
    """The 32-bit polynomial hash (factor 31) of a string's characters, as a signed long; for ASCII, as ids are."""
    places = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    codes = F.transform(places, lambda i: F.ascii(F.substring(text, i, F.lit(1))).cast("long"))
    hashed = F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: (a * 31 + c) % (1 << 32))
    for size in reversed(SHORT):
        hashed = F.when((F.length(text) <= size) & (F.octet_length(text) == F.length(text)), _short_hash(text, size)).otherwise(hashed)
    # As the sign is taken without naming the sum twice, it is computed once.
    return F.pmod(hashed + (1 << 31), F.lit(1 << 32)) - (1 << 31)


def slice_of(pid: Column, slices: int = SLICES) -> Column:
    """The shard of an entity: abs(hash % slices)."""
    return F.abs(string_hash(pid) % slices).cast("int")


def key_partition(key: Column, partitions: int = 5) -> Column:
    """The partition of a projection key in a wide-column offset table."""
    return F.abs(string_hash(key) % partitions).cast("int")


def persistence_id(entity_type: Column, entity_id: Column) -> Column:
    return F.concat_ws(SEPARATOR, entity_type, entity_id)


def entity_type(pid: Column) -> Column:
    """What stands before the first separator; empty if there is none."""
    return F.when(pid.contains(SEPARATOR), F.substring_index(pid, SEPARATOR, 1)).otherwise(F.lit(""))


def entity_id(pid: Column) -> Column:
    """What stands after the first separator; the whole id if there is none."""
    at = F.instr(pid, SEPARATOR)
    return F.when(at > 0, F.substring(pid, at + 1, F.length(pid))).otherwise(pid)


def with_replica(pid: Column, replica: Column | str) -> Column:
    """The id with its last part, the replica, exchanged."""
    replica = F.lit(replica) if isinstance(replica, str) else replica
    return F.concat(F.regexp_replace(pid, r"[^|]*$", ""), replica)


def full_match(text: Column, pattern: str) -> Column:
    return text.rlike(f"^(?:{pattern})$")


def strip_trailing_separators(topic: Column) -> Column:
    """Trailing slashes go, unless the topic has nothing else."""
    return F.when(topic.rlike("^/+$"), topic).otherwise(F.regexp_replace(topic, "/+$", ""))


def to_micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def from_micros(micros: Column) -> Column:
    return F.timestamp_micros(micros)


def to_millis(ts: Column) -> Column:
    return F.unix_millis(ts)


def distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance by the haversine formula, in whole metres."""
    dlat, dlon = F.sin(F.radians(lat1 - lat2) / 2), F.sin(F.radians(lon1 - lon2) / 2)
    a = dlat * dlat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * dlon * dlon
    return (2 * F.atan2(F.sqrt(a), F.sqrt(1 - a)) * EARTH_RADIUS_M).cast("long")


def coarse(degrees: Column) -> Column:
    """Rounded to hundredths, halves up."""
    return F.floor(degrees * 100 + 0.5) / 100


def topic_key(topic: Column, partition: Column) -> Column:
    """A message log's partition as a key: topic-partition."""
    return F.concat_ws("-", topic, partition.cast("string"))


def parse_topic_key(key: Column) -> tuple[Column, Column]:
    """Topic and partition of a key; the topic may itself contain hyphens."""
    pattern = r"^(.+)-([0-9]+)$"
    return F.regexp_extract(key, pattern, 1), F.regexp_extract(key, pattern, 2).try_cast("int")


def check_topic(expression: str) -> None:
    """Raise ValueError for an empty expression or a first wildcard that isn't a whole level (the multi-level one also last)."""
    if not expression:
        raise ValueError("a topic expression can't be empty")
    levels = lambda i: (expression[i - 1], expression[i + 1] if i + 1 < len(expression) else "/")
    i = expression.find("+")
    if i > 0 and levels(i) != ("/", "/"):
        raise ValueError(f"+ must be a whole level: {expression}")
    j = expression.find("#")
    if j > 0 and (j != len(expression) - 1 or expression[j - 1] != "/"):
        raise ValueError(f"# must be the whole last level: {expression}")


def topic_pattern(expression: str) -> str | None:
    """An anchored pattern for stripped topics; None if the expression is exact, "" if it matches everything."""
    check_topic(expression)
    if expression == "#":
        return ""
    if "+" not in expression and "#" not in expression:
        return None
    levels = expression.split("/")
    while levels and not levels[-1]:
        levels.pop()
    parts = []
    for level in levels:
        parts.append(".*" if level == "#" else "[^/]*" if level == "+" else re.escape(level))
        if level == "#":
            break
    return f"^{'/'.join(parts)}$"


def topic_matches(topic: Column, expression: str) -> Column:
    """Whether a topic matches an expression with + for one level and # for one or more levels at the end."""
    pattern = topic_pattern(expression)
    if pattern == "":
        return F.lit(True)
    if pattern is None:
        return topic == expression
    return ~topic.rlike("^/+$") & strip_trailing_separators(topic).rlike(pattern)


def tags_match_topic(tags: Column, expression: str, prefix: str = TOPIC_PREFIX) -> Column:
    """Whether any topic tag matches; # alone matches envelopes without tags too."""
    if topic_pattern(expression) == "":
        return F.lit(True)
    return F.coalesce(F.exists(tags, lambda t: t.startswith(prefix) & topic_matches(F.substring(t, F.lit(len(prefix) + 1), F.length(t)), expression)), F.lit(False))


def correlation_id(seed: str, key: Column) -> Column:
    """An id in the form of a UUID for a key of a run, the same each time."""
    return F.regexp_replace(F.md5(F.concat(F.lit(f"{seed}:"), key)), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")
