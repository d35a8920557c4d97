"""Filling containers of fixed capacity with items of varying length.

Lengths are whole numbers up to the capacity, so the packing is planned on their counts (at most
``capacity`` of them, whatever the number of items). Exact complements come first: for the longest
length the missing single length, pair or triple that fills the container exactly, as often as the
counts allow. What remains goes best-fit, longest first. Items are then numbered within their length
and take the places the plan has for that length.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.tokenizer import VOCABULARY, token_counts
from strandlake.operators.chunking import RANK, number_rows
from strandlake.session import stage

CAPACITY = 4096


class Plan:
    """Places by length: items numbered ``low`` and on, ``per`` to a container, from container ``first`` on."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.n_containers = capacity, 0
        self.left = np.zeros(capacity + 1, "int64")
        for length, n in counts.items():
            self.left[length] = n
        self.taken = np.zeros(capacity + 1, "int64")
        self.places: list[tuple[int, int, int, int]] = []  # (length, low, first, per)
        self._exact()
        self._best_fit()
        self.places.sort()

    def _put(self, length: int, per: int, containers: int, first: int) -> None:
        self.places.append((length, int(self.taken[length]), first, per))
        self.taken[length] += per * containers
        self.left[length] -= per * containers

    def _fill(self, lengths: list[int]) -> None:
        """As many containers of exactly these lengths as the counts allow."""
        need: dict[int, int] = defaultdict(int)
        for x in lengths:
            need[x] += 1
        times = min(int(self.left[x]) // k for x, k in need.items())
        for x, k in need.items():
            self._put(x, k, times, self.n_containers)
        self.n_containers += times

    def _single(self, gap: int) -> list[int] | None:
        return [gap] if self.left[gap] > 0 else None

    def _pair(self, gap: int) -> list[int] | None:
        """Two lengths whose sum is the gap, the longer one as long as possible."""
        a = np.arange((gap + 1) // 2, gap)
        b = gap - a
        fit = (self.left[a] > 0) & (self.left[b] > 0) & ((a != b) | (self.left[a] > 1))
        at = np.flatnonzero(fit)
        return [int(a[at[-1]]), int(b[at[-1]])] if len(at) else None

    def _triple(self, gap: int) -> list[int] | None:
        have = np.flatnonzero(self.left[:gap])
        for c in have[::-1].tolist():
            if 3 * c < gap:
                return None
            self.left[c] -= 1
            found = self._pair(gap - c) if gap - c >= 2 else None
            self.left[c] += 1
            if found:
                return [c, *found]
        return None

    def _exact(self) -> None:
        full = self.capacity
        for length in range(full, 0, -1):
            while self.left[length] > 0:
                gap = full - length
                if not gap:
                    self._fill([length])
                    continue
                self.left[length] -= 1
                rest = self._single(gap) or self._pair(gap) or self._triple(gap)
                self.left[length] += 1
                if not rest:
                    break
                self._fill([length, *rest])

    def _best_fit(self) -> None:
        room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free length -> (first container, number)
        free = np.zeros(self.capacity + 1, "int64")
        for length in range(self.capacity, 0, -1):
            while (n := int(self.left[length])) > 0:
                fits = np.flatnonzero(free[length:])
                if len(fits):
                    r = int(fits[0]) + length
                    first, number = room[r].pop()
                    free[r] -= number
                    per = min(r // length, n)
                    used = min(number, n // per)
                    self._put(length, per, used, first)
                    parts = [(r - per * length, first, used), (r, first + used, number - used)]
                else:
                    per = min(self.capacity // length, n)
                    used = n // per
                    first, self.n_containers = self.n_containers, self.n_containers + used
                    self._put(length, per, used, first)
                    parts = [(self.capacity - per * length, first, used)]
                for r, first, number in parts:
                    if r and number:
                        room[r].append((first, number))
                        free[r] += number


def _placer(plan: Plan):
    lengths, low, first, per = (np.array(x, "int64") for x in zip(*plan.places)) if plan.places else (np.zeros(0, "int64"),) * 4
    shift = int(2**40)
    keys = lengths * shift + low
    n_containers = max(1, plan.n_containers)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = (batch.column(i).to_numpy() for i in (3, 4))
            at = np.searchsorted(keys, n * shift + rank, "right") - 1
            where = rank % n_containers
            real = n > 0
            at = at[real]
            where[real] = first[at] + (rank[real] - low[at]) // per[at]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(where)], names=["_sl_key", "piece_no", "start_token", "n_tokens", "container_id"]
            )

    return work


def pack(items: DataFrame, key: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """key, piece_no, start_token, n_tokens, container_id (0, 1, ...) of every item.

    An item longer than the capacity is cut into pieces of exactly the capacity and a rest; no other is
    cut. Null and negative sizes count as 0; items of size 0 take no room and are spread over the
    containers (all are in container 0 if there is none). Equal rows are separate items. An empty table
    gives no rows. The counts planned on the driver are at most ``capacity`` + 1 rows. A length may have
    up to 2^40 items.
    """
    n = F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0))
    rows = items.select(F.col(key).alias("_sl_key"), n.alias("_sl_n"))
    last = F.expr(f"greatest(_sl_n - 1, 0) div {capacity}")
    pieces = rows.select("_sl_key", "_sl_n", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece_no")).select(
        "_sl_key",
        F.col("piece_no").cast("int").alias("piece_no"),
        (F.col("piece_no") * capacity).alias("start_token"),
        F.least(F.lit(capacity).cast("bigint"), F.col("_sl_n") - F.col("piece_no") * capacity).alias("n_tokens"),
    )
    # Ranges of lengths: a part holds few lengths, so the numbering has as many offsets as there are lengths and parts.
    sized = stage(pieces, "sized")
    numbered = number_rows(sized.df.repartitionByRange("n_tokens", "_sl_key"), ["n_tokens"])
    sized.drop()
    counts = {r[0]: r[1] for r in numbered.sizes().collect() if r[0] > 0}  # at most capacity + 1 rows
    plan = Plan(counts, capacity)
    kind = items.schema[key].dataType.simpleString()
    placed = numbered.df.select("_sl_key", "piece_no", "start_token", "n_tokens", RANK).mapInArrow(
        _placer(plan), f"_sl_key {kind}, piece_no int, start_token bigint, n_tokens bigint, container_id bigint"
    )
    return placed.withColumnRenamed("_sl_key", key)


def pack_documents(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """Documents packed by their number of tokens; null and empty texts have size 0."""
    return pack(token_counts(df, key, text, vocabulary), key, "n_tokens", capacity)
