"""Deterministic hashing: splits, seeds, record hashes, file fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import c


def hash32(text) -> Column:
    """First four bytes of sha-256 as an unsigned integer."""
    return F.conv(F.substring(F.sha2(c(text).cast("string"), 256), 1, 8), 16, 10).cast("bigint")


def hash_fraction(text) -> Column:
    """``hash32`` scaled to [0, 1)."""
    return hash32(text) / F.lit(float(2**32))


def hash_split(identity, ratios=(0.7, 0.15, 0.15), seed: int = 0) -> Column:
    """Identity-disjoint split: every row of an identity lands on the same side."""
    train, val, _ = ratios
    u = hash_fraction(F.concat(F.lit(f"{seed}:"), c(identity)))
    return F.when(u < train, "train").when(u < train + val, "val").otherwise("test")


def sample_seed(video_id, epoch=0) -> Column:
    """Per-video sampling seed, stable for a given epoch."""
    e = epoch if isinstance(epoch, Column) else F.lit(str(epoch))
    return hash32(F.concat(c(video_id), F.lit(":"), e.cast("string")))


def record_hash(record, n: int = 16) -> Column:
    """Short hash of a struct or map, over its JSON with keys in order.

    A struct is hashed through a map of its fields, so field order never matters.
    """
    return F.substring(F.sha2(c(record), 256), 1, n)


def sorted_json(fields: dict) -> Column:
    """JSON object with keys in order; values are column names or columns of any type."""
    parts = [c(v).alias(k) for k, v in sorted(fields.items())]
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})


def fingerprint(content, length, head_bytes: int | None = None) -> Column:
    """sha-256 over the content followed by the decimal size; over ``head_bytes`` of it, if given."""
    head = F.substring(c(content), 1, head_bytes) if head_bytes else c(content)
    return F.sha2(F.concat(head, F.encode(c(length).cast("string"), "utf-8")), 256)
