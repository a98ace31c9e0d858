"""Groups of rows dealt out in blocks, so that no task holds a whole hot group.

A group of ``parts`` blocks becomes ``parts`` groups: a row is a member of its own
block and asks every block before it, so any two rows of the group meet in one
block. Groups of one block, nearly all, cost nothing extra.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys of split groups that may be broadcast: 16 bytes each.
FEW = 100_000


def dealt(rows: DataFrame, key: str, name: str, parts: DataFrame) -> DataFrame:
    """``rows`` with ``part``, ``parts`` and ``asks``, shuffled by key and part, members first. ``parts`` (key, parts): the groups of several blocks."""
    n = parts.limit(FEW + 1).count()
    if not n:
        out = rows.withColumns({"part": F.lit(0).cast("bigint"), "parts": F.lit(1).cast("bigint"), "asks": F.lit(False)})
    else:
        known = rows.join(F.broadcast(parts) if n <= FEW else parts, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)).cast("bigint"))
        known = known.withColumn("_own", F.pmod(F.xxhash64(F.lit(11), F.col(name)), F.col("parts")))
        out = known.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), "_own"))).withColumn("asks", F.col("part") != F.col("_own")).drop("_own")
    return out.repartition(key, "part").sortWithinPartitions(key, "part", "asks", name)


def groups(batches: Iterator[pd.DataFrame], key: str, askers: int) -> Iterator[pd.DataFrame]:
    """Whole blocks of sorted ``dealt`` rows; the members of a block come again with each ``askers`` rows that ask them."""
    now: tuple | None = None
    members: list[pd.DataFrame] = []
    asking: list[pd.DataFrame] = []
    met = False  # whether the members have been given out

    for batch in batches:
        if not len(batch):
            continue
        where = batch[[key, "part"]].to_numpy()
        cuts = (where[1:] != where[:-1]).any(1).nonzero()[0] + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(batch)]):
            if now != tuple(where[lo]):
                if asking or members and not met:
                    yield pd.concat([*members, *asking], ignore_index=True)
                now, members, asking, met = tuple(where[lo]), [], [], False
            part = batch.iloc[lo:hi]
            asks = part["asks"].to_numpy(bool)
            if not asks.all():
                members.append(part[~asks])
            ask = part[asks]
            for at in range(0, len(ask), askers):
                asking.append(ask.iloc[at : at + askers])
                if sum(map(len, asking)) >= askers:
                    yield pd.concat([*members, *asking], ignore_index=True)
                    asking, met = [], True
    if asking or members and not met:
        yield pd.concat([*members, *asking], ignore_index=True)
