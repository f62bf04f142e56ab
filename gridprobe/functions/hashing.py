"""Checksums and seeded pseudo-random keys."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

_COLUMN_DIGESTS = {
    "md5": F.md5,
    "sha1": F.sha1,
    "sha224": lambda c: F.sha2(c, 224),
    "sha256": lambda c: F.sha2(c, 256),
    "sha384": lambda c: F.sha2(c, 384),
    "sha512": lambda c: F.sha2(c, 512),
}

# 15 hexadecimal digits fit a signed 64-bit integer.
HASH_DIGITS = 15
HASH_SPAN = 16**HASH_DIGITS


def checksum(data: Column, algorithm: str = "sha256") -> Column:
    """Hex digest of a text or binary column."""
    if algorithm not in _COLUMN_DIGESTS:
        raise ValueError(f"Unknown algorithm: {algorithm}")
    return _COLUMN_DIGESTS[algorithm](data)


def canonical_json(config: dict) -> str:
    return json.dumps(config, indent=2, sort_keys=True)


def config_checksum(config: dict, algorithm: str = "sha256") -> str:
    """Identity of a configuration: the digest of its canonical JSON."""
    if algorithm not in _COLUMN_DIGESTS:
        raise ValueError(f"Unknown algorithm: {algorithm}")
    return hashlib.new(algorithm, canonical_json(config).encode()).hexdigest()


def _seeded(seed: int, *parts) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def hash_key(seed: int, *parts) -> Column:
    """A uniform, reproducible integer in [0, 16^15) per row."""
    return F.conv(F.substring(_seeded(seed, *parts), 1, HASH_DIGITS), 16, 10).cast("bigint")


def hash_unit(seed: int, *parts) -> Column:
    """A uniform, reproducible number in [0, 1) per row."""
    return F.conv(F.substring(_seeded(seed, *parts), 1, 8), 16, 10).cast("double") / float(2**32)
