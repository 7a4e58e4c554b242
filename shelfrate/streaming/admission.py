"""Streaming admission of promotion requests (T5).

Requests arrive on a stream; all requests of one category, and those for its
products, form one group whose accepted windows live in Spark state
(``applyInPandasWithState``). A CATEGORY request is checked against the
accepted CATEGORY windows, a PRODUCT request against those of its product
and of its category (Q1), in (arrival, id) order. Every accepted window
stays in state: overlap does not depend on the present time, and a later
request may start in the past. So the decisions are those of the batch fold
(M12) however the stream is cut into micro-batches, as long as a micro-batch
does not arrive before an earlier one.

The accepted windows of one target are disjoint; a group's state holds those
of one category and its products, and a task holds one group's requests of
one micro-batch (bounded by the trigger).
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shelfrate.functions.timeutil import epoch_micros

OUTPUT_SCHEMA = "id string, target_key string, admitted boolean"
STATE_SCHEMA = "targets array<string>, starts array<bigint>, ends array<bigint>"


class Windows:
    """Disjoint windows of one target, by start."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def clash(self, start: int, end: int) -> bool:
        i = bisect.bisect_right(self.starts, start)
        return (i > 0 and self.ends[i - 1] > start) or (i < len(self.starts) and self.starts[i] < end)

    def add(self, start: int, end: int) -> None:
        i = bisect.bisect_right(self.starts, start)
        self.starts.insert(i, start)
        self.ends.insert(i, end)


def _decide(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    accepted: dict[str, Windows] = defaultdict(Windows)
    if state.exists:
        for target, start, end in zip(*state.get, strict=True):
            accepted[target].add(start, end)
    batch = pd.concat(list(pdfs), ignore_index=True).sort_values(["arrival", "id"])
    verdicts = []
    for target, start, end in zip(batch["target_key"], batch["s"], batch["e"], strict=True):
        free = not any(accepted[t].clash(int(start), int(end)) for t in {target, key[0]})
        if free:
            accepted[target].add(int(start), int(end))
        verdicts.append(free)
    rows = [(t, s, e) for t, w in accepted.items() for s, e in zip(w.starts, w.ends, strict=True)]
    state.update(tuple(list(c) for c in zip(*rows, strict=True)) if rows else ([], [], []))
    yield pd.DataFrame({"id": batch["id"].astype(str), "target_key": batch["target_key"], "admitted": verdicts})


def admit_stream(requests: DataFrame, products: DataFrame) -> DataFrame:
    """``requests``: id, scope, target_product_id, target_category_id,
    starts_at, ends_at and ``arrival`` (long); ``products`` (static): id,
    category_id. Returns a stream of ``id, target_key, admitted`` (append
    mode)."""
    cats = products.select(F.col("id").cast("string").alias("__pid"), F.col("category_id").cast("string").alias("__cat"))
    keyed = requests.withColumn("__s", epoch_micros(requests, "starts_at")).withColumn(
        "__e", epoch_micros(requests, "ends_at"))
    keyed = keyed.join(cats, keyed["target_product_id"].cast("string") == cats["__pid"], "left")
    own = F.concat(F.lit("P|"), F.col("target_product_id").cast("string"))
    category = F.concat(F.lit("C|"), F.when(F.col("scope") == "PRODUCT", F.col("__cat"))
                        .otherwise(F.col("target_category_id").cast("string")))
    rows = keyed.select(
        F.col("id").cast("string").alias("id"),
        F.when(F.col("scope") == "PRODUCT", own).otherwise(category).alias("target_key"),
        F.coalesce(category, own).alias("group_key"),  # a product of no known category is a group of its own
        F.col("__s").alias("s"), F.col("__e").alias("e"), F.col("arrival").cast("bigint").alias("arrival"))
    return rows.groupBy("group_key").applyInPandasWithState(
        _decide, OUTPUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)
