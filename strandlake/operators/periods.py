"""Continuous periods and the gaps between them, per entity.

Starts and ends are sorted independently. With the k-th smallest end of an entity and its (k+1)-th
smallest start, a gap exists exactly where that start exceeds that end; the boundaries on both sides
of two neighbouring gaps are a period. Entities of any size are cut into position ranges: a range
doesn't know how many starts and ends lie before it, but the rank shift at which its gaps can occur
is its largest surplus of ends over starts, so ranges are worked through once and joined afterwards
by their totals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.session import stage

_RANGE, _PERIOD, _GAP = 0, 1, 2
_SCHEMA = (
    "part int, entity string, what int, a bigint, b bigint, "
    "n_starts bigint, n_ends bigint, surplus bigint, first_pos bigint, last_pos bigint, head_end bigint, tail_start bigint"
)


def _range_rows(part: int, names: np.ndarray, code: np.ndarray, pos: np.ndarray, n_start: np.ndarray, n_end: np.ndarray) -> pa.RecordBatch:
    """Rows of the entities ``names`` whose events, in order, have the codes 0, 1, ... in ``code``."""
    k, n = len(names), len(pos)
    first = np.searchsorted(code, np.arange(k))
    last = np.append(first[1:], n) - 1
    before_s, before_e = (np.append(0, np.cumsum(c))[first] for c in (n_start, n_end))
    # Ranks within the entity: the last end at pos has rank ends_ranked; the next-ranked start lies beyond pos.
    starts_ranked, ends_ranked = np.cumsum(n_start) - before_s[code], np.cumsum(n_end) - before_e[code]
    surplus = np.maximum.reduceat(ends_ranked - starts_ranked, first)
    at = np.flatnonzero(ends_ranked - starts_ranked == surplus[code])
    after = at[at != last[code[at]]]
    pair = np.flatnonzero(code[at[1:]] == code[at[:-1]])
    opens, closes = at[pair] + 1, at[pair + 1]
    head = at[np.searchsorted(code[at], np.arange(k))]
    tail = at[np.searchsorted(code[at], np.arange(k), "right") - 1]
    open_tail = tail == last
    own = np.arange(k)
    entity = np.concatenate([own, code[opens], code[after]])
    what = np.repeat(np.array([_RANGE, _PERIOD, _GAP], "int32"), [k, len(opens), len(after)])
    zero = np.zeros(k, "int64")
    a, b = np.concatenate([zero, pos[opens], pos[after]]), np.concatenate([zero, pos[closes], pos[after + 1]])
    rest = pa.nulls(len(entity) - k, pa.int64())

    def ranges(values: np.ndarray, mask: np.ndarray | None = None) -> pa.Array:
        return pa.concat_arrays([pa.array(values.astype("int64"), mask=mask), rest])

    arrays = [pa.array(np.full(len(entity), part, "int32")), pa.array(names, pa.string()).take(pa.array(entity)), pa.array(what), pa.array(a), pa.array(b)]
    arrays += [ranges(v) for v in (starts_ranked[last], ends_ranked[last], surplus, pos[first], pos[last], pos[head])]
    arrays += [ranges(pos[np.minimum(tail + 1, n - 1)], open_tail)]
    return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in _SCHEMA.split(", ")])


def _work_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    held: list[pa.RecordBatch] = []

    def flush(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        found = table.column(0).chunk(0).dictionary_encode()
        return _range_rows(
            part, found.dictionary.to_numpy(zero_copy_only=False), found.indices.to_numpy(), *(table.column(i).to_numpy() for i in (1, 2, 3))
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        # Whole entities are worked through; the last one may go on in the next batch.
        same = pc.equal(batch.column(0), batch.column(0)[-1]).to_numpy(zero_copy_only=False)
        cut = int(np.argmax(same))
        goes_on = bool(held) and held[-1].column(0)[-1] == batch.column(0)[-1]
        if not goes_on and (held or cut):
            done = [*held, batch.slice(0, cut)] if cut else held
            yield flush(done)
            held = []
        held.append(batch if goes_on else batch.slice(cut))
    if held:
        yield flush(held)


def periods_and_gaps(df: DataFrame, entity: str = "chrom", start: str = "start_pos", end: str = "end_pos") -> DataFrame:
    """kind (``period`` or ``gap``), entity, start, end for every entity.

    Rows with a null in the three columns or with start >= end do not count. Touching intervals are
    one period. Nothing is listed before an entity's first or after its last period. Repeated rows and
    ties change nothing. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    rows = df.select(
        F.col(entity).cast("string").alias("entity"), F.col(start).cast("bigint").alias("s"), F.col(end).cast("bigint").alias("e")
    ).where("entity is not null and s < e")
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    ends = F.array(
        F.struct(F.col("s").alias("pos"), one.alias("n_start"), none.alias("n_end")),
        F.struct(F.col("e").alias("pos"), none.alias("n_start"), one.alias("n_end")),
    )
    events = (
        rows.select("entity", F.inline(ends))
        .groupBy("entity", "pos")
        .agg(F.sum("n_start").alias("n_start"), F.sum("n_end").alias("n_end"))
    )
    ordered = events.repartitionByRange("entity", "pos").sortWithinPartitions("entity", "pos")
    worked = stage(ordered.mapInArrow(_work_ranges, _SCHEMA), "periods").df

    along = Window.partitionBy("entity").orderBy("part")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        worked.where(F.col("what") == _RANGE)
        .withColumn("depth", F.coalesce(F.sum(F.col("n_starts") - F.col("n_ends")).over(before), F.lit(0)))
        .withColumn("closed", F.col("depth") == F.col("surplus"))
    )
    prev = lambda c: F.lag(c).over(along)
    joined = (
        ranges.withColumns({"p_closed": prev("closed"), "p_tail": prev("tail_start"), "p_last": prev("last_pos")})
        .withColumn(
            "opens",
            F.when(F.col("p_closed").isNull() | (F.col("p_closed") & F.col("p_tail").isNull()), F.col("first_pos")).when(
                F.col("p_closed"), F.col("p_tail")
            ),
        )
        .withColumn("opened", F.last("opens", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    )
    across = joined.select(
        "entity",
        F.inline(
            F.array(
                F.struct(F.when(F.col("closed"), F.lit("period")).alias("kind"), F.col("opened").alias("a"), F.col("head_end").alias("b")),
                F.struct(
                    F.when(F.col("p_closed") & F.col("p_tail").isNull(), F.lit("gap")).alias("kind"),
                    F.col("p_last").alias("a"),
                    F.col("first_pos").alias("b"),
                ),
            )
        ),
    ).where("kind is not null")
    inner = worked.where(F.col("what") != _RANGE).join(
        ranges.where("closed").select("entity", "part"), ["entity", "part"], "left_semi"
    )
    inside = inner.select("entity", F.when(F.col("what") == _PERIOD, "period").otherwise("gap").alias("kind"), "a", "b")
    return inside.unionByName(across).select(
        "kind", F.col("entity").alias(entity), F.col("a").alias(start), F.col("b").alias(end)
    )
