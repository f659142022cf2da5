"""DataFrame-to-DataFrame building blocks."""

from playlens.operators.bloom import UserFilter
from playlens.operators.intervals import attribute_to_level, first_per_user, level_intervals
from playlens.operators.sets import (
    FewUsers,
    count_users,
    in_users,
    join_labels,
    label_by_membership,
    memberships,
    not_in_users,
    segment_users,
    tag,
    union,
)
from playlens.operators.shape import (
    centered_mean,
    cumulative_distribution,
    merge_by_level,
    pivot_labels,
    share_of_total,
    with_baseline,
)

__all__ = [
    "FewUsers",
    "UserFilter",
    "attribute_to_level",
    "centered_mean",
    "count_users",
    "cumulative_distribution",
    "first_per_user",
    "in_users",
    "join_labels",
    "label_by_membership",
    "level_intervals",
    "memberships",
    "merge_by_level",
    "not_in_users",
    "pivot_labels",
    "segment_users",
    "share_of_total",
    "tag",
    "union",
    "with_baseline",
]
