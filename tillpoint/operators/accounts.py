"""Accounts and trusted devices: JN3, JN4, FL7, WN5, SO10.

Devices are filtered *before* the left join with users (the reference puts
the activity test in the ON clause; filtering after the join would drop
users without a device).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.functions.dates import ntz_lit


def _ts(now: str):
    return ntz_lit(now)


def expiry_sweep(devices: DataFrame, now: str) -> DataFrame:
    """FL7: an unrevoked device whose expiry has passed is revoked at its expiry."""
    return devices.withColumn(
        "revoked_at", F.coalesce(F.col("revoked_at"),
                                 F.when(F.col("expires_at") <= _ts(now), F.col("expires_at"))))


def active_devices(devices: DataFrame, now: str) -> DataFrame:
    """FL7: ``revoked_at IS NULL AND expires_at > now``."""
    return devices.filter(F.col("revoked_at").isNull() & (F.col("expires_at") > _ts(now)))


def users_with_device(t, now: str) -> DataFrame:
    """JN3 + SO10: every user with their active trusted device, if any."""
    d = active_devices(t.user_devices, now).select(
        F.col("user_id"), F.col("id").alias("trusted_device_id"),
        F.col("device_name").alias("trusted_device_name"),
        F.col("created_at").alias("trusted_device_created_at"),
        F.col("last_used_at").alias("trusted_device_last_used_at"))
    u = t.users
    return (u.join(d, u.id == d.user_id, "left").drop("user_id")
             .orderBy("full_name", "username"))


def device_owner(t, now: str) -> DataFrame:
    """JN4: active devices with their owner (the token lookup's join)."""
    d = active_devices(expiry_sweep(t.user_devices, now), now)
    u = t.users.select(F.col("id").alias("uid"), "username", "full_name", "role", "is_active")
    return (d.join(u, d.user_id == u.uid, "inner")
             .select(F.col("id").alias("device_id"), "user_id", "device_name", "pin_enabled", "created_at",
                     "last_used_at", "expires_at", "username", "full_name", "role", "is_active"))


def device_history(t, now: str) -> DataFrame:
    """WN5: every registration with how it ended as of ``now``: replaced by the
    user's next registration, expired, or still active."""
    d = expiry_sweep(t.user_devices, now)
    state = (F.when(F.col("revoked_at").isNull(), F.lit("active"))
              .when(F.col("revoked_at") == F.col("expires_at"), F.lit("expired"))
              .otherwise(F.lit("replaced")))
    return d.select("id", "user_id", "created_at", "expires_at", "revoked_at", state.alias("state"))
