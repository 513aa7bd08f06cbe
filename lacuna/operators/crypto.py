"""Password encryption of mapping tables and texts: PBKDF2-SHA256 and AES-256-GCM.

The key is derived in a vectorized helper that closes over the password, so neither stands in a plan. Wrong passwords
and altered data give null; ``decrypted`` parts such rows from the others.

Defined cases: null texts and salts give null data; a null mapping is sealed as null and opens as null; repeated rows
stay apart; other columns stay, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions.spans import free
from lacuna.operators.redact import ENTRY

#: Rounds, key, salt and IV sizes.
ROUNDS, KEY_BYTES, SALT_BYTES, IV_BYTES = 100_000, 32, 16, 12


def check_password(password: str, confirmation: str) -> None:
    """At least six characters, given twice alike."""
    if len(password) < 6:
        raise ValueError("the password needs at least 6 characters")
    if password != confirmation:
        raise ValueError("the passwords differ")


def valid_password(password: Column, confirmation: Column) -> Column:
    """The same rule for columns; null passwords fail."""
    return F.coalesce((F.length(password) >= 6) & (password == confirmation), F.lit(False))


@lru_cache(maxsize=4096)
def key_of(password: str, salt: bytes) -> bytes:
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, ROUNDS, KEY_BYTES)


def derive_key(salt: Column, password: str) -> Column:
    """The key of each salt; null for a null salt."""

    def of(salts: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else key_of(password, bytes(s)) for s in salts])

    return F.pandas_udf(of, "binary")(salt)


def random_bytes(n: int, *anchors: Column) -> Column:
    """n random bytes for each row. Not the same on a second run: write the result once and read it back."""

    def of(rows: pd.Series) -> pd.Series:
        return pd.Series([os.urandom(n) for _ in rows])

    udf = F.pandas_udf(of, "binary").asNondeterministic()
    return udf(anchors[0] if anchors else F.monotonically_increasing_id())


def encrypt_text(df: DataFrame, column: str, password: str, salt: Column | None = None, iv: Column | None = None, prefix: str = "") -> DataFrame:
    """The input and ``data`` (ciphertext and tag), ``salt`` and ``iv``. One salt given for all rows costs one derivation per task."""
    df = df.withColumns({f"{prefix}salt": salt if salt is not None else random_bytes(SALT_BYTES), f"{prefix}iv": iv if iv is not None else random_bytes(IV_BYTES)})
    key = free(df, "__key")
    df = df.withColumn(key, derive_key(F.col(f"{prefix}salt"), password))
    sealed = F.aes_encrypt(F.col(column).cast("binary"), F.col(key), F.lit("GCM"), F.lit("DEFAULT"), F.col(f"{prefix}iv"))
    return df.withColumn(f"{prefix}data", F.substring(sealed, IV_BYTES + 1, 2147483647)).drop(key)


def decrypt_text(df: DataFrame, password: str, out: str = "text", prefix: str = "") -> DataFrame:
    """The input and ``out``; null where password or data are wrong."""
    key = free(df, "__key")
    df = df.withColumn(key, derive_key(F.col(f"{prefix}salt"), password))
    opened = F.try_aes_decrypt(F.concat(f"{prefix}iv", f"{prefix}data"), F.col(key), F.lit("GCM"), F.lit("DEFAULT"))
    return df.withColumn(out, opened.cast("string")).drop(key)


def decrypted(df: DataFrame, password: str, out: str = "text", prefix: str = "") -> tuple[DataFrame, DataFrame]:
    """The rows that open, with ``out``, and the rejects with their ``reason``: data that the password doesn't open."""
    opened = decrypt_text(df, password, out, prefix)
    return opened.where(F.col(out).isNotNull()), opened.where(F.col(out).isNull()).drop(out).withColumn("reason", F.lit("wrong password or altered data"))


def encrypt_mapping(df: DataFrame, password: str, mapping: str = "mapping", salt: Column | None = None, iv: Column | None = None) -> DataFrame:
    """The mapping as JSON, encrypted: ``data, salt, iv``."""
    json = free(df, "__json")
    return encrypt_text(df.withColumn(json, F.to_json(mapping)), json, password, salt, iv).drop(json)


def decrypt_mapping(df: DataFrame, password: str, out: str = "mapping") -> DataFrame:
    json = free(df, "__json")
    return decrypt_text(df, password, json).withColumn(out, F.from_json(json, ENTRY)).drop(json)


def meta_envelope(name: Column, salt: Column, iv: Column, data: Column) -> Column:
    """The parts in base64 between tags, with the file's name made safe."""
    tag = lambda t, c: F.concat(F.lit(f"<{t}>"), c, F.lit(f"</{t}>"))
    safe = F.regexp_replace(name, "[<>&\"']", "_")
    return F.concat(F.lit("<meta>"), tag("name", safe), tag("salt", F.base64(salt)), tag("iv", F.base64(iv)), tag("data", F.base64(data)), F.lit("</meta>"))


def parse_meta(text: Column) -> Column:
    """``struct<salt, iv, data>`` of an envelope; null parts where a tag is missing."""
    part = lambda t: F.unbase64(F.nullif(F.regexp_replace(F.regexp_extract(text, f"<{t}>([^<]+)</{t}>", 1), r"\s+", ""), F.lit("")))
    return F.struct(*(part(t).alias(t) for t in ("salt", "iv", "data")))
