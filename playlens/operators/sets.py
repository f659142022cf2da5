"""User sets: membership, semi and anti joins, labels, distinct counts."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlens.model import LABEL, USER, quoted
from playlens.operators.bloom import UserFilter

FewUsers = bool | UserFilter


def count_users(
    df: DataFrame, *keys: str, name: str = "num_user", error: float | None = None
) -> DataFrame:
    """Distinct users per key, or over everything when no key is given.

    Spark drops repeats of (key, user) before the shuffle and spreads a key's
    users over all tasks, so neither a busy user nor a large key is a hot spot.
    The count is exact; a relative ``error`` asks for an estimate instead, which
    shuffles a sketch per key rather than its users.
    """
    users = F.countDistinct(USER) if error is None else F.approx_count_distinct(USER, error)
    return df.groupBy(*keys).agg(users.alias(name))


def in_users(df: DataFrame, users: DataFrame) -> DataFrame:
    """Rows whose user is in the set."""
    return df.join(users.select(USER), USER, "left_semi")


def not_in_users(df: DataFrame, users: DataFrame) -> DataFrame:
    """Rows whose user is known and not in the set.

    With NULL ids refused on both sides this is ``NOT IN``, but as an ordinary
    anti join, which can shuffle when the set is too large to send around.
    """
    known = f"{USER} is not null"
    return df.filter(known).join(users.filter(known).select(USER), USER, "left_anti")


def join_labels(facts: DataFrame, labels: DataFrame, few_users: FewUsers = False) -> DataFrame:
    """Facts of labelled users, with their label.

    ``few_users`` is for labels that cover a small part of all players and come
    from a written table.  It adds a semi join, which leaves the result alone; if
    Spark finds the table small enough to send around, it carries the semi join
    down through the facts' aggregation, and other users go at the scan.  For labels too many
    to send around it can be a :class:`playlens.operators.bloom.UserFilter` of them, which
    sends a few bits per user instead.
    """
    if isinstance(few_users, UserFilter):
        facts = few_users.keep(facts)
    elif few_users:
        facts = in_users(facts, labels)
    return facts.join(labels, USER)


def tag(df: DataFrame, **flags: str) -> DataFrame:
    """A row per event that says, in SQL conditions, which sets its user belongs to."""
    return df.selectExpr(USER, *(f"{condition} as {name}" for name, condition in flags.items()))


def union(*parts: DataFrame) -> DataFrame:
    """All rows of all parts; a column that a part lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _beside(tagged: tuple[DataFrame, ...], of_first: bool) -> DataFrame:
    """Sets that lie in buckets by user, each collapsed where it lies, side by side."""

    def collapsed(rows: DataFrame) -> DataFrame:
        flags = [column for column in rows.columns if column != USER]
        known = rows.filter(f"{USER} is not null").groupBy(USER)
        return known.agg(*(F.bool_or(flag).alias(flag) for flag in flags))

    how = "left" if of_first else "full_outer"
    both = reduce(lambda a, b: a.join(b, USER, how), map(collapsed, tagged))
    flags = [column for column in both.columns if column != USER]
    return both.select(USER, *(F.coalesce(flag, F.lit(False)).alias(flag) for flag in flags))


def memberships(
    *tagged: DataFrame, of_first: bool = False, by_user: bool = False
) -> DataFrame:
    """One row per known user with a true/false column for every tag.

    All sets meet in a single aggregation: a user's repeats collapse before the
    one shuffle, and no set has to be joined or fit in memory.  ``of_first`` leaves out users
    who have no event in the first set.  If all sets come from tables that are bucketed alike
    ``by_user``, and every tag from one of them, they are merged bucket by bucket and nothing
    is shuffled; users of the first set then keep their place for what comes next.
    """
    if by_user:
        return _beside(tagged, of_first)
    if of_first:
        first = [column for column in tagged[0].columns if column != USER]
        return memberships(*tagged).filter(" or ".join(first))
    rows = union(*tagged)
    flags = [column for column in rows.columns if column != USER]
    return (
        rows.filter(f"{USER} is not null")
        .groupBy(USER)
        .agg(*(F.expr(f"coalesce(bool_or({flag}), false) as {flag}") for flag in flags))
    )


def label_by_membership(
    members: DataFrame, rules: Mapping[str, str], otherwise: str | None = None
) -> DataFrame:
    """``(user, label)`` from the first rule that holds; NULL when none does."""
    cases = " ".join(f"when {condition} then {quoted(label)}" for label, condition in rules.items())
    default = "" if otherwise is None else f"else {quoted(otherwise)}"
    return members.selectExpr(USER, f"case {cases} {default} end as {LABEL}")


def segment_users(labels: DataFrame, label: str) -> DataFrame:
    """The users who carry one label."""
    return labels.filter(f"{LABEL} = {quoted(label)}").select(USER)
