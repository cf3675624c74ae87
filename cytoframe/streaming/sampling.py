"""The first N tracks of each key across batches: later batches only fill what is left."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def first_tracks(rows: DataFrame, keys: Sequence[str], n: int, batch: str = "batch", order: str = "arrival", ident: str = "track_id") -> DataFrame:
    """(keys, ident, place): the first n ids of each key by batch, then by their first `order` in it, then by id; place from 1.

    An id counts once, where it comes first. Rows without an id are left out; n below 1 keeps none.
    """
    first = rows.where(F.col(ident).isNotNull()).groupBy(*keys, ident).agg(F.min(F.struct(batch, order)).alias("_first"))
    w = Window.partitionBy(*keys).orderBy("_first", ident)
    return first.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).drop("_first")


def first_tracks_stream(rows: DataFrame, keys: Sequence[str], n: int, order: str = "arrival", ident: str = "track_id") -> DataFrame:
    """first_tracks over a stream, with its micro-batches for batches: each appends the ids that it adds.

    The state of a key is its ids so far, n at most; of a micro-batch a task holds the first `order` of each
    id that isn't kept yet. Once a key is full its rows pass by.
    """
    kinds = dict(rows.dtypes)
    names = ", ".join(f"`{k}` {kinds[k]}" for k in keys)

    def fill(key: tuple, parts, state: GroupState):
        kept = list(state.get[0]) if state.exists else []
        known, seen = set(kept), {}
        for part in parts:
            if len(kept) >= n:
                continue
            part = part[~part[ident].isin(known)]
            for i, at in part.groupby(ident)[order].min().items():
                seen[i] = min(at, seen.get(i, at))
        fresh = [i for _, i in sorted((at, i) for i, at in seen.items())][: max(0, n - len(kept))]
        if fresh:
            state.update((kept + fresh,))
            yield pd.DataFrame({**{k: [v] * len(fresh) for k, v in zip(keys, key)}, ident: fresh, "place": range(len(kept) + 1, len(kept) + len(fresh) + 1)})

    wanted = rows.where(F.col(ident).isNotNull()).select(*keys, ident, order)
    return wanted.groupBy(*keys).applyInPandasWithState(fill, f"{names}, `{ident}` {kinds[ident]}, place int", f"kept array<{kinds[ident]}>", "append", GroupStateTimeout.NoTimeout)
