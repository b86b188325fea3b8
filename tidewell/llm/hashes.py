"""Content hashes as they are compared."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_hash(column: str) -> Column:
    """A content hash as it is compared: lower case, without blanks and a leading algorithm; empty becomes null."""
    bare = F.regexp_replace(F.lower(F.trim(F.col(column))), r"^(md5|sha1|sha256)\s*[:=]\s*", "")
    return F.when(F.length(bare) > 0, bare)
