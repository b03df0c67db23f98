"""Registered account and device queries (QY13, JN3, JN4, FL7, WN5)."""

from __future__ import annotations

from tillpoint import params as P
from tillpoint.operators import accounts as A
from tillpoint.plans.present import flat
from tillpoint.plans.registry import register
from tillpoint.plans.sqlviews import with_views

NOW = P.DEVICE_NOW


def ts(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S.%f')"


@register("users_with_device", with_views(f"""
WITH trusted AS (
  SELECT user_id, id AS trusted_device_id, device_name AS trusted_device_name,
         {ts('created_at')} AS trusted_device_created_at, {ts('last_used_at')} AS trusted_device_last_used_at
  FROM user_devices WHERE expires_at > TIMESTAMP '{NOW}' AND revoked_at IS NULL),
people AS (SELECT id AS user_id, username, full_name, role, CAST(is_active AS BIGINT) AS is_active FROM users)
SELECT user_id AS id, * EXCLUDE (user_id) FROM people LEFT JOIN trusted USING (user_id)""", "users", "user_devices"))
def users_with_device(t):
    return flat(A.users_with_device(t, NOW))


@register("device_owner", with_views(f"""
WITH swept AS (
  SELECT * REPLACE (COALESCE(revoked_at, CASE WHEN expires_at <= TIMESTAMP '{NOW}' THEN expires_at END) AS revoked_at)
  FROM user_devices)
SELECT d.id AS device_id, d.user_id, d.device_name, CAST(d.pin_enabled AS BIGINT) AS pin_enabled,
       {ts('d.created_at')} AS created_at, {ts('d.last_used_at')} AS last_used_at, {ts('d.expires_at')} AS expires_at,
       u.username, u.full_name, u.role, CAST(u.is_active AS BIGINT) AS is_active
FROM swept d INNER JOIN users u ON u.id = d.user_id
WHERE d.revoked_at IS NULL AND d.expires_at > TIMESTAMP '{NOW}'""", "users", "user_devices"))
def device_owner(t):
    return flat(A.device_owner(t, NOW))


@register("devices_active", with_views(f"""
SELECT id, user_id, device_name, CAST(pin_enabled AS BIGINT) AS pin_enabled, {ts('created_at')} AS created_at,
       {ts('last_used_at')} AS last_used_at, {ts('expires_at')} AS expires_at, {ts('revoked_at')} AS revoked_at
FROM user_devices WHERE revoked_at IS NULL AND expires_at > TIMESTAMP '{NOW}'""", "user_devices"))
def devices_active(t):
    return flat(A.active_devices(t.user_devices, NOW))


@register("device_history", with_views(f"""
WITH swept AS (
  SELECT id, user_id, created_at, expires_at,
         COALESCE(revoked_at, CASE WHEN expires_at <= TIMESTAMP '{NOW}' THEN expires_at END) AS revoked_at
  FROM user_devices)
SELECT id, user_id, {ts('created_at')} AS created_at, {ts('expires_at')} AS expires_at, {ts('revoked_at')} AS revoked_at,
       CASE WHEN revoked_at IS NULL THEN 'active' WHEN revoked_at = expires_at THEN 'expired' ELSE 'replaced' END AS state
FROM swept""", "user_devices"))
def device_history(t):
    return flat(A.device_history(t, NOW))
