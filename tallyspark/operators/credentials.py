"""Credentials table: token record projection (P15), encrypted columns (P16),
latest row per tenant (W1), auto-touch (U6, via upsert.auto_touch) and the
connection status report (J8).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.exprs import aes_key, decrypt, encrypt, parse_number

SECRET_COLUMNS = ["id_token", "access_token", "refresh_token"]


def _int(c: Column) -> Column:
    # Stored in INT columns: a fractional value rounds (half away from zero); one that does not fit is NULL, so a
    # single odd payload does not end the job (overflowing_tokens finds it).
    return F.round(parse_number(c)).try_cast("int")


def to_token_record(payload: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Incoming token payload (all strings) -> table columns.  Numbers
    parse leniently (unparsable -> NULL)."""
    keep = keep or ["tenant_id", "realm_id"]
    return payload.select(
        *keep,
        F.col("state"), _int(F.col("latency")).alias("latency"), F.col("id_token"),
        F.round(parse_number(F.col("createdAt"))).try_cast("long").alias("created_at"),
        _int(F.col("expires_in")).alias("expires_in"), F.col("token_type"),
        F.col("access_token"), F.col("refresh_token"),
        _int(F.col("x_refresh_token_expires_in")).alias("x_refresh_token_expires_in"),
    )


def overflowing_tokens(payload: DataFrame) -> DataFrame:
    """Payloads with a number that does not fit its column, to be rejected."""
    def over(c: str, kind: str) -> Column:
        n = F.round(parse_number(F.col(c)))
        return n.isNotNull() & n.try_cast(kind).isNull()
    return payload.where(over("latency", "int") | over("expires_in", "int") | over("x_refresh_token_expires_in", "int") | over("createdAt", "long"))


def from_token_record(rows: DataFrame) -> DataFrame:
    """P15 reverse: table row -> payload names (binary decoded as UTF-8)."""
    def dec(c):
        return F.col(c).cast("string") if dict(rows.dtypes)[c] == "binary" else F.col(c)
    return rows.select(
        F.col("state"), F.col("latency"), F.col("realm_id").alias("realmId"), dec("id_token").alias("id_token"),
        F.col("created_at").alias("createdAt"), F.col("expires_in"), F.col("token_type"),
        dec("access_token").alias("access_token"), dec("refresh_token").alias("refresh_token"),
        F.col("x_refresh_token_expires_in"))


def encrypt_cols(df: DataFrame, cols: list[str], secret: str, mode: str = "GCM") -> DataFrame:
    """AES with a 16-byte key derived from ``secret`` (MD5).  GCM (default)
    is randomised; use 'ECB' only where equal plaintexts must give equal
    ciphertexts."""
    key = aes_key(F.lit(secret))
    return df.select(*[encrypt(F.col(c), key, mode).alias(c) if c in cols else F.col(c) for c in df.columns])


def decrypt_cols(df: DataFrame, cols: list[str], secret: str, mode: str = "GCM") -> DataFrame:
    key = aes_key(F.lit(secret))
    return df.select(*[decrypt(F.col(c), key, mode).cast("string").alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def latest_by(df: DataFrame, keys: list[str], order_cols: list[str]) -> DataFrame:
    """The row with the greatest ``order_cols`` per key (ORDER BY ... DESC
    LIMIT 1, for all keys at once).  A partial max-of-struct aggregation, so a
    key holding a third of the rows is reduced map-side; give a tie-break
    column last in ``order_cols``."""
    rest = [c for c in df.columns if c not in keys]
    w = df.groupBy(*keys).agg(F.max(F.struct(*[F.col(c).alias("_o%d" % i) for i, c in enumerate(order_cols)],
                                             F.struct(*rest).alias("_row"))).alias("_w"))
    return w.select(*keys, *[F.col("_w._row")[c].alias(c) for c in rest])


def connection_status(tenants: DataFrame, tokens: DataFrame, now_ms: int) -> DataFrame:
    """Tenants left-joined to their latest token.  'not_connected' without
    a token; 'connected' while the access token, or else the refresh token, is
    valid; 'needs_reconnect' once both have expired.  Validity: access until
    created_at + expires_in * 1000 ms, refresh until created_at +
    x_refresh_token_expires_in * 1000 ms."""
    latest = latest_by(tokens, ["tenant_id"], ["updated_at", "realm_id"])
    j = tenants.select("tenant_id").distinct().join(latest, "tenant_id", "left")
    now = F.lit(now_ms).cast("long")
    access_ok = now < F.col("created_at") + F.col("expires_in").cast("long") * 1000
    refresh_ok = now < F.col("created_at") + F.col("x_refresh_token_expires_in").cast("long") * 1000
    status = (F.when(F.col("realm_id").isNull(), F.lit("not_connected"))
              .when(F.coalesce(access_ok, F.lit(False)) | F.coalesce(refresh_ok, F.lit(False)), F.lit("connected"))
              .otherwise(F.lit("needs_reconnect")))
    return j.select("tenant_id", status.alias("status"), "realm_id")
