"""Fixed values shared by every query.

The engine never reads the wall clock: "today" is an explicit parameter.
The defaults below are the ones the registered queries and their SQL
oracles use, so that both sides agree.
"""

from __future__ import annotations

# -- fixed values: clock for the registered queries -------------------------
AS_OF = "2000-06-15"                    # the shop's "today" (sales clock)
DEVICE_NOW = "2024-01-25 00:00:00"      # "now" for device / login state
REQUEST_SHIFT_DAYS = 8614               # events are moved back into June 2000
LOCAL_OFFSET_HOURS = 8                  # digital requests: UTC + 8 h local day

# -- fixed values: status words ---------------------------------------------
IN_STOCK = "In Stock"
LOW_STOCK = "Low Stock"
OUT_OF_STOCK = "Out of Stock"
LOW_OR_OUT = "Low/Out of Stock"

PENDING = "Pending"
COMPLETED = "Completed"
FAILED = "Failed"

# -- fixed values: lockout presets (max failures, window minutes, lock minutes)
ACCOUNT_LOCKOUT = (5, 15, 15)
ADDRESS_LOCKOUT = (10, 10, 10)
PIN_LOCKOUT = (5, 15, 15)

# -- fixed values: session idle limit in minutes ----------------------------
SESSION_IDLE_MINUTES = 30
