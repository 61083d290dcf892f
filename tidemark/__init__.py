"""Bounded questions over stored telemetry, answered by Spark."""

from .operators.key_counts import key_profile, update_key_counts
from .operators.refresh import full_refresh, refresh_policy, refresh_window
from .operators.rollup import create_rollup, publish_rollup
from .operators.zones import update_zones
from .plans.timeseries import plan_timeseries
from .sources.registry import Registry, Source, discover
from .sources.storage import store_by_day
from .streaming.rollup_stream import absorb, retire_landed, stream_rollup
from .workspace import Workspace

__all__ = [
    "Registry",
    "Source",
    "Workspace",
    "absorb",
    "create_rollup",
    "discover",
    "full_refresh",
    "key_profile",
    "plan_timeseries",
    "publish_rollup",
    "refresh_policy",
    "refresh_window",
    "retire_landed",
    "store_by_day",
    "stream_rollup",
    "update_key_counts",
    "update_zones",
]
