"""Seeds and evaluation identifiers: 64-bit words mixed by SplitMix64, 128-bit identifiers as 16 bytes."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# What separates seeds of rows, split requests, sampled requests, features, Latin hypercubes and models.
ROW_DOMAIN = 0x74656E61785F726F
SPLIT_DOMAIN = 0x74656E61785F7370
SAMPLE_REQUEST_DOMAIN = 0x74656E61785F7361
SAMPLE_FEATURE_DOMAIN = 0x74656E61785F6665
LHS_REQUEST_DOMAIN = 0x74656E61785F6C68
LHS_FEATURE_DOMAIN = 0x74656E61785F6C66
MODEL_DOMAIN = 0x74656E61785F6D6F

_GOLDEN, _M1, _M2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_WORD = (1 << 64) - 1


def splitmix64(x: int) -> int:
    x = (x + _GOLDEN) & _WORD
    x = (x ^ x >> 30) * _M1 & _WORD
    x = (x ^ x >> 27) * _M2 & _WORD
    return x ^ x >> 31


def derive_seed(root: int, sequence: int, domain: int) -> int:
    return splitmix64((root ^ domain ^ sequence * _GOLDEN & _WORD) & _WORD)


def splitmix64_array(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + np.uint64(_GOLDEN)
        x = (x ^ x >> np.uint64(30)) * np.uint64(_M1)
        x = (x ^ x >> np.uint64(27)) * np.uint64(_M2)
    return x ^ x >> np.uint64(31)


def derive_seed_array(root, sequence: np.ndarray, domain: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return splitmix64_array(np.asarray(root, np.uint64) ^ np.uint64(domain) ^ sequence.astype(np.uint64) * np.uint64(_GOLDEN))


def seed_column(root: Column, sequence: Column, domain: int) -> Column:
    """derive_seed for columns: root as DECIMAL(20,0), sequence as a long; DECIMAL(20,0)."""

    @pandas_udf("long")
    def derive(root: pd.Series, sequence: pd.Series) -> pd.Series:
        return pd.Series(derive_seed_array(root.to_numpy().view(np.uint64), sequence.to_numpy(), domain).view(np.int64))

    span = F.lit(Decimal(1 << 64))
    bits = F.when(root >= F.lit(Decimal(1 << 63)), root - span).otherwise(root).cast("long")
    found = derive(bits, sequence.cast("long"))
    return F.when(found < 0, found.cast("decimal(21,0)") + span).otherwise(found.cast("decimal(21,0)")).cast("decimal(20,0)")


def evaluation_id(run_seed: int, sequence: int) -> bytes:
    """Run seed and sequence as a 128-bit number, big-endian: bytes order as numbers do."""
    return (run_seed << 64 | sequence).to_bytes(16, "big")


def id_hex(identifier: Column | bytes) -> Column | str:
    return identifier.hex() if isinstance(identifier, bytes) else F.lower(F.hex(identifier))


def id_plus(identifier: Column, offset: Column) -> Column:
    """Adds to the low 64 bits of an identifier, which must not overflow."""
    low = F.conv(F.hex(F.substring(identifier, 9, 8)), 16, 10).cast("decimal(20,0)") + offset
    return F.concat(F.substring(identifier, 1, 8), F.unhex(F.lpad(F.conv(low.cast("decimal(20,0)").cast("string"), 10, 16), 16, "0")))
