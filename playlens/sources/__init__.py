"""Raw log in, flattened event tables out."""

from playlens.sources.ingest import (
    RAW_EVENT_SCHEMA,
    Param,
    flatten_event,
    flatten_new,
    raw_event_schema,
    read_events,
    shard_range,
    write_bucketed,
    write_event_table,
    write_event_tables,
)

__all__ = [
    "RAW_EVENT_SCHEMA",
    "Param",
    "flatten_event",
    "flatten_new",
    "raw_event_schema",
    "read_events",
    "shard_range",
    "write_bucketed",
    "write_event_table",
    "write_event_tables",
]
