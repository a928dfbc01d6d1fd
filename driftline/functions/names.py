"""Normal forms of observation names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tod_key(name: Column) -> Column:
    """The name without outer white space, directories, letter case and one final ``.zip``; null stays null."""
    bare = F.regexp_replace(name, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    base = F.lower(F.regexp_replace(bare, r"^.*[/\\]", ""))
    return F.regexp_replace(base, r"\.zip$", "")
