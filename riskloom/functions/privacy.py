"""Pseudonyms: HMAC-SHA256 as a built-in expression, composite ids, random tokens."""

from __future__ import annotations

import hashlib
import secrets

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLOCK = 64


def _pads(salt: str) -> tuple[str, str]:
    key = salt.encode()
    key = (hashlib.sha256(key).digest() if len(key) > _BLOCK else key).ljust(_BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()


def hmac_sha256(c: Column, salt: str, strict_blank: bool = True) -> Column:
    """Hex HMAC-SHA256 of a value as text, unstripped. Null for null and for blank values (``strict_blank``), or for null
    and the empty string only."""
    inner, outer = _pads(salt)
    text = c.cast("string")
    digest = F.sha2(F.concat(F.unhex(F.lit(inner)), text.cast("binary")), 256)
    digest = F.sha2(F.concat(F.unhex(F.lit(outer)), F.unhex(digest)), 256)
    empty = (F.trim(F.regexp_replace(text, r"\s", "")) if strict_blank else text) == ""
    return F.when(text.isNotNull() & ~empty, digest)


def hash_columns(df: DataFrame, columns: list[str], salt: str) -> DataFrame:
    """Adds ``{column}_hash`` for each of ``columns`` that ``df`` has."""
    return df.withColumns({f"{c}_hash": hmac_sha256(F.col(c), salt) for c in columns if c in df.columns})


def entity_id(salt: str, *parts: Column) -> Column:
    """HMAC of the non-null parts, joined by ``|``."""
    return hmac_sha256(F.concat_ws("|", *[p.cast("string") for p in parts]), salt)


def verify_hash(c: Column, digest: Column, salt: str) -> Column:
    return hmac_sha256(c, salt).eqNullSafe(digest) & digest.isNotNull()


def random_token(length: int = 32) -> Column:
    """Hex of ``length`` cryptographically random bytes, new for each row and each evaluation."""

    @F.pandas_udf("string")
    def token(rows: pd.Series) -> pd.Series:
        return pd.Series([secrets.token_hex(length) for _ in rows])

    return token.asNondeterministic()(F.lit(1))


def token_table(df: DataFrame, column: str, path: str, length: int = 32) -> DataFrame:
    """One random token for each distinct value of ``column`` (null is one value), written to ``path`` once and read from
    there, as another evaluation would draw other tokens."""
    df.select(F.col(column).alias("id")).distinct().withColumn("token", random_token(length)).write.parquet(path)
    return df.sparkSession.read.parquet(path)
