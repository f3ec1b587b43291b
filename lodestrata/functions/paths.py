"""Normal forms of the ledger's columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_path(path: Column) -> Column:
    """Forward slashes, no leading ``./`` (however often); null and empty give null."""
    slashed = F.translate(path, "\\", "/")
    bare = F.regexp_replace(slashed, r"^(?:\./)+", "")
    return F.when(bare != "", bare)


def normal_hash(value: Column) -> Column:
    """Lower case; null and empty give null."""
    return F.when(value != "", F.lower(value))
