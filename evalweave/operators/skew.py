"""Joins whose big side may have hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from evalweave.session import stage


def lookup_join(
    facts: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "left", *, stored: bool = False
) -> DataFrame:
    """Join ``facts`` to a ``lookup`` with unique ``on`` keys, whatever the key distribution.

    The lookup is written once (unless it is ``stored``, a plain read of files), so Catalyst knows its
    size: within ``spark.sql.autoBroadcastJoinThreshold`` the facts are not shuffled at all. Beyond, a
    hot key, null included, makes one large partition of facts, which the adaptive skew join splits
    over as many tasks as it fills; only the lookup rows of that partition are read again. ``how`` is
    a join that keeps the facts' side whole, as those are what a split leaves right.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"a lookup is no {how} join")
    return facts.join(lookup if stored else stage(lookup, "lookup"), list(on), how)
