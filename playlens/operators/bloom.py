"""A Bloom filter of users, or of other keys under their name, built by Spark and tested where facts are scanned."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playlens.model import USER

#: Bits per expected user and positions set for each: about one in a hundred others gets through.
BITS_PER_USER, HASHES = 10, 7
#: Bits at least and at most.  Beyond 16 MiB, which every task gets, more others get through.
LEAST_BITS, MOST_BITS = 1 << 12, 1 << 27
_WORD = 64


def _positions(bits: int, user: Column) -> list[Column]:
    """The bits of a user: two hashes, the second added again and again."""
    low = F.lit((1 << 31) - 1).cast("long")
    one = F.xxhash64(user).bitwiseAND(low)
    step = F.xxhash64(user, F.lit(1)).bitwiseAND(low)
    return [F.pmod(one + step * i, F.lit(bits).cast("long")) for i in range(HASHES)]


@dataclass(frozen=True)
class UserFilter:
    """``words`` is one row with an array of longs, the filter's ``bits``; nothing runs until it is used."""

    words: DataFrame
    bits: int

    @classmethod
    def of(cls, users: DataFrame, expected: int) -> UserFilter:
        """A filter of about so many users; with more of them it only lets more others through."""
        wanted = min(max(expected * BITS_PER_USER, LEAST_BITS), MOST_BITS)
        bits = 1 << (wanted - 1).bit_length()
        place = F.explode(F.array(*_positions(bits, F.col(USER))))
        word = F.call_function("div", F.col("bit"), F.lit(_WORD)).alias("word")
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % _WORD).cast("int"))
        known = users.filter(f"{USER} is not null").select(place.alias("bit"))
        found = known.groupBy(word).agg(F.bit_or(mask).alias("mask"))
        every = users.sparkSession.range(0, bits // _WORD, 1, 1).withColumnRenamed("id", "word")
        dense = every.join(found, "word", "left").select(
            F.struct("word", F.coalesce("mask", F.lit(0).cast("long")).alias("mask")).alias("entry")
        )
        ordered = F.array_sort(F.collect_list("entry"))  # at most MOST_BITS / 64 longs
        return cls(dense.agg(F.transform(ordered, lambda e: e["mask"]).alias("words")), bits)

    def _tests(self, user: Column) -> list[Column]:
        """A condition for each bit of a user."""
        words, tests = self.words.scalar(), []
        for bit in _positions(self.bits, user):
            word = F.element_at(words, (F.call_function("div", bit, F.lit(_WORD)) + 1).cast("int"))
            tests.append(F.call_function("bit_get", word, (bit % _WORD).cast("int")) == 1)
        return tests

    def keep(self, facts: DataFrame) -> DataFrame:
        """Facts of the filter's users and of few others; over an aggregation by user it acts below it."""
        for test in self._tests(F.col(USER)):
            facts = facts.filter(test)
        return facts

    def holds(self, user: Column) -> Column:
        """True for the filter's users and few others; false for null.  ``user`` has the type of the filter's users."""
        found = user.isNotNull()
        for test in self._tests(user):
            found = found & test
        return found
