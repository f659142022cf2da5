"""Player-behaviour analytics on mobile-game event logs, on Spark DataFrames."""

from playlens.model import CohortSpec, DateRange, EventTables, Scope, SkillRule

__all__ = ["CohortSpec", "DateRange", "EventTables", "Scope", "SkillRule"]
