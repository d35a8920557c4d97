"""Cutting oversized texts at natural boundaries, with a fixed overlap between neighbours.

Dynamic programming over the natural boundaries: the cost of a way of cutting is the pair (number of
forced cuts, penalties of its natural cuts plus the sum of squared differences of its piece lengths
from the mean piece length, in units of the limit), compared in this order. Between two natural cuts
the fewest forced cuts are best, and evenly spaced ones cost least, so a transition is a closed form.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_COLUMNS, OVERLAP = 1000, 50
GAP_RUN = "-{5,}"


def cut_positions(n: int, natural: np.ndarray, limit: int, overlap: int, penalty: np.ndarray | None = None) -> tuple[list[int], list[bool]]:
    """Ends of all pieces but the last, and which of them are forced.

    Pieces have at most ``limit`` columns and begin ``overlap`` columns before the one before them ends.
    ``penalty`` is the cost of a cut at each natural boundary (0 by default), beside the imbalance.
    """
    step = limit - overlap
    inside = (natural > overlap) & (natural < n)
    order = np.argsort(natural[inside], kind="stable")
    at = natural[inside][order]
    cost_at = np.zeros(len(at)) if penalty is None else penalty[inside][order]
    if len(at):
        first = np.flatnonzero(np.append(True, np.diff(at) > 0))
        at, cost_at = at[first], np.minimum.reduceat(cost_at, first)
    # The start counts as a boundary at ``overlap``, so that a piece from a to b has b - a + overlap columns.
    at = np.concatenate([[overlap], at, [n]]).astype("int64")
    cost_at = np.concatenate([[0.0], cost_at, [0.0]])
    k = max(1, -(-(n - overlap) // step))
    mean = (n + (k - 1) * overlap) / k
    forced, cost, via = np.zeros(len(at), "int64"), np.zeros(len(at)), np.zeros(len(at), "int64")
    low = 0
    for i in range(1, len(at)):
        # forced - at / step never rises from boundary to boundary, so those that can reach this one with
        # the fewest forced cuts are the last ones, from ``low`` on.
        pieces = -(-(at[i] - at[low:i]) // step)
        count = forced[low:i] + pieces - 1
        fewest = count.min()
        short, more = np.divmod(at[i] - at[low:i], pieces)
        short = short + overlap - mean
        way = cost[low:i] + ((pieces - more) * short**2 + more * (short + 1) ** 2) / limit**2
        way[count > fewest] = np.inf
        j = int(np.argmin(way))
        forced[i], cost[i], via[i] = fewest, way[j] + cost_at[i], low + j
        while (forced[low] - forced[i] - 1) * step - at[low] + at[i] > 0:
            low += 1
    cuts, how, i = [], [], len(at) - 1
    while i > 0:
        a, b = int(at[via[i]]), int(at[i])
        pieces = -(-(b - a) // step)
        cuts += [a + (b - a) * q // pieces for q in range(pieces, 0, -1)]
        how += [False, *[True] * (pieces - 1)]
        i = int(via[i])
    return cuts[:0:-1], how[:0:-1]


def _pieces(limit: int, overlap: int, boundary: Sequence[tuple[str, float]], gap: str, names: list[str]):
    runs = [(re.compile(pattern), float(weight)) for pattern, weight in boundary]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            row, rows = [], []
            for i, text in enumerate(batch.column(0).to_pylist()):
                found = [(m.end(), weight) for run, weight in runs for m in run.finditer(text)]
                natural, penalty = (np.array([x[c] for x in found], t) for c, t in ((0, "int64"), (1, float)))
                cuts, forced = cut_positions(len(text), natural, limit, overlap, penalty)
                begin = before = 0
                for no, (end, how) in enumerate(zip([*cuts, len(text)], [*forced, False])):
                    part = text[begin:end]
                    row.append(i)
                    rows.append((no, begin, end, before, len(part) - part.count(gap), part, how))
                    nxt = end - overlap
                    before += nxt - begin - text.count(gap, begin, nxt)
                    begin = nxt
            own = [pa.array(v, t) for v, t in zip(zip(*rows), (pa.int32(), *[pa.int64()] * 4, pa.string(), pa.bool_()))]
            carried = batch.take(pa.array(row, pa.int64())).columns[1:]
            yield pa.RecordBatch.from_arrays([*carried, *own], names=names)

    return work


def split_texts(
    df: DataFrame, carry: Sequence[str], text: str, *, limit: int = MAX_COLUMNS, overlap: int = OVERLAP,
    boundary: str | Sequence[tuple[str, float]] = GAP_RUN, gap: str = "-",
) -> DataFrame:
    """The columns ``carry``, then piece_no, col_start, col_end, n_before, n_own, piece_text, forced.

    One row for each piece of every text longer than ``limit`` columns. A natural boundary is the place
    right after a match of ``boundary``, a pattern or several with the penalty of a cut there (what a piece
    that differs from the mean length by the whole limit costs is 1); ``forced`` tells that the piece ends at none (false for the last
    piece). n_before and n_own count the characters other than ``gap`` before and in the piece. Null,
    empty and short texts give no pieces; equal rows give equal pieces; an empty table gives none.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    kinds = [(boundary, 0.0)] if isinstance(boundary, str) else list(boundary)
    long = df.where(F.length(text) > limit).select(
        F.col(text).alias("_sl_text"), *[F.col(c).alias(f"_sl_{i}") for i, c in enumerate(carry)]
    )
    kept = ", ".join(f"_sl_{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))
    added = "piece_no int, col_start bigint, col_end bigint, n_before bigint, n_own bigint, piece_text string, forced boolean"
    names = [f"_sl_{i}" for i in range(len(carry))] + [c.split()[0] for c in added.split(", ")]
    out = long.mapInArrow(_pieces(limit, overlap, kinds, gap, names), f"{kept}, {added}")
    return out.withColumnsRenamed({f"_sl_{i}": c for i, c in enumerate(carry)})


def split_components(df: DataFrame, *, limit: int = MAX_COLUMNS, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of oversized alignment components, with their own start and size.

    A piece's size is the number of its characters that aren't gaps, whatever ``aln_size`` says; its
    start adds those before it to the component's start (null stays null).
    """
    pieces = split_texts(df, ["comp_id", "start_pos"], "text", limit=limit, overlap=overlap)
    return pieces.select(
        "comp_id", "piece_no", "col_start", "col_end", (F.col("start_pos") + F.col("n_before")).alias("start_pos"),
        F.col("n_own").alias("aln_size"), "piece_text", "forced",
    )
