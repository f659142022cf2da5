"""The analyses: functions from event tables and a spec to a result DataFrame."""
