"""Path and record-name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SAFE_ID = r"^[A-Za-z0-9_-]+$"


def _parts(path: Column) -> Column:
    return F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda p: (p != "") & (p != "."))


def normal_path(path: Column) -> Column:
    """Forward slashes, with `.` and `..` resolved as far as the path's own start."""
    kept = F.aggregate(
        _parts(path),
        F.array().cast("array<string>"),
        lambda acc, p: F.when(p != "..", F.concat(acc, F.array(p))).otherwise(
            F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        ),
    )
    return F.array_join(kept, "/")


def inside_root(path: Column) -> Column:
    """True when the path stays below its root at every step and is not the root itself.

    Symbolic links are not followed: object stores have none.
    """
    walk = F.aggregate(
        _parts(path),
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("lowest")),
        lambda acc, p: F.struct(
            (acc.depth + F.when(p == "..", -1).otherwise(1)).alias("depth"),
            F.least(acc.lowest, acc.depth + F.when(p == "..", -1).otherwise(1)).alias("lowest"),
        ),
    )
    absolute = F.translate(path, "\\", "/").startswith("/")
    return ~absolute & (walk.lowest >= 0) & (walk.depth > 0)


def record_id(given: Column | None, path: Column, prefix: str = "") -> Column:
    """The given id, or else the first 24 hex digits of the path's sha256."""
    derived = F.concat(F.lit(prefix), F.substring(F.sha2(path, 256), 1, 24))
    return derived if given is None else F.coalesce(F.nullif(given, F.lit("")), derived)


def safe_id(ident: Column) -> Column:
    return ident.rlike(SAFE_ID)
