"""Column expressions."""

from playlens.functions.columns import (
    band,
    calendar_days,
    checked,
    elapsed_days,
    event_param,
    parse_event_date,
    ratio,
    time_bucket,
)

__all__ = [
    "band",
    "calendar_days",
    "checked",
    "elapsed_days",
    "event_param",
    "parse_event_date",
    "ratio",
    "time_bucket",
]
