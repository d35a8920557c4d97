"""The N best items of every group, reading only the row groups that can hold them.

Rows are written once in files clustered by group: a file holds a range of (group, score descending),
so a group is in one file unless it is large. Within a file a row group holds one band of ranks (a
group's first 4 rows, its next 8, its next 16, ...), of one large group or of many small ones, so the
maxima of every group descend from band to band. The index keeps for every row group the highest score
of each group in it. Row groups are read by band, within a band in descending maximum score, and one is skipped where every
contained group's highest score is strictly below that group's current N-th score. Files that only
continue a large group wait until the N-th score of its first file is known; most are then never opened.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.session import Staged, shared_dir, small_side, stage

#: Ranks in a group's first band (each band has twice those of the one before) and the rows of a full row group.
FIRST_BAND, ROW_GROUP_ROWS = 4, 32_000
#: Candidates a task holds before it hands them on.
_HELD = 200_000


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if urlparse(path).scheme in ("", "file"):
        return pafs.LocalFileSystem(), urlparse(path).path
    return pafs.FileSystem.from_uri(path)


def _writer(folder: str, group: str, score: str, first_band: int, row_group_rows: int):
    """Writes a task's rows as one file and returns its index; files of lost attempts are in no index."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = f"{folder}/{uuid.uuid4().hex}.parquet"
        fs, at = _open(path)
        held: dict[int, list[pa.RecordBatch]] = {}
        n_held: dict[int, int] = {}
        sink, written, last, seen = None, 0, None, 0

        def flush(band: int) -> pa.RecordBatch:
            nonlocal sink, written
            table = pa.Table.from_batches(held.pop(band))
            n_held.pop(band)
            if sink is None:
                fs.create_dir(at.rpartition("/")[0], recursive=True)
                sink = pq.ParquetWriter(at, table.schema, filesystem=fs, write_statistics=[score])
            sink.write_table(table, row_group_size=len(table))
            found = table.select([group, score]).group_by(group, use_threads=False).aggregate([(score, "max"), (score, "count")])
            k = len(found)
            own = [found.column(c).combine_chunks() for c in (group, f"{score}_max", f"{score}_count")]
            head = [pa.array([path] * k, pa.string()), pa.array(np.full(k, written, "int32")), pa.array(np.full(k, band, "int32"))]
            written += 1
            return pa.RecordBatch.from_arrays([*head, *own], names=["path", "row_group", "band", "g", "top", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(batch.schema.get_field_index(group)).dictionary_encode()
            code = codes.indices.to_numpy()
            first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            rank = np.arange(len(code)) - np.repeat(first, np.diff(np.append(first, len(code))))
            if last is not None and codes.dictionary[int(code[0])].equals(last):
                rank[code == code[0]] += seen
            last, seen = codes.dictionary[int(code[-1])], int(rank[-1]) + 1
            band = np.log2(rank // first_band + 1).astype("int64")
            order = np.argsort(band, kind="stable")
            cuts = np.flatnonzero(np.append(True, np.diff(band[order]) > 0)).tolist() + [len(order)]
            for a, b in zip(cuts, cuts[1:]):
                k = int(band[order[a]])
                held.setdefault(k, []).append(batch.take(pa.array(order[a:b])))
                n_held[k] = n_held.get(k, 0) + b - a
                if n_held[k] >= row_group_rows:
                    yield flush(k)
        for k in sorted(held):
            yield flush(k)
        if sink is not None:
            sink.close()

    return work


def _comparable(column: pa.ChunkedArray) -> pa.ChunkedArray:
    """-0.0 as 0.0 and one NaN, so that equal values have equal bytes."""
    if not pa.types.is_floating(column.type):
        return column
    return pc.if_else(pc.is_nan(column), pa.scalar(float("nan"), column.type), pc.add(column, pa.scalar(0.0, column.type)))


def _reader(names: list[str], group: str, score: str, item: list[str], n: int, groups_read, rows_read):
    """Reads files given by (path, row groups, their groups and highest scores, scores already reached)."""

    class Reached:
        """The N-th scores known so far, by group."""

        def __init__(self, groups: pa.Array, scores: pa.Array):
            self.groups, self.scores = groups, scores

        def open(self, groups, scores) -> pa.Array:
            """Where a score isn't strictly below its group's N-th."""
            at = pc.index_in(groups, value_set=self.groups)
            known = self.scores.take(at) if len(self.groups) else pa.nulls(len(at), scores.type)
            return pc.fill_null(pc.greater_equal(scores, known), True)

        def update(self, items: pa.Table) -> None:
            order = items.sort_by([(group, "ascending"), (score, "descending")])
            codes = order.column(group).combine_chunks().dictionary_encode()
            code = codes.indices.to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            nth = first + n - 1
            nth = nth[nth < np.append(first[1:], len(code))]
            now = order.select([group, score]).take(pa.array(nth))
            was = pa.table({group: self.groups, score: self.scores}) if len(self.groups) else now.slice(0, 0)
            both = pa.concat_tables([was, now]).group_by(group, use_threads=False).aggregate([(score, "max")])
            self.groups, self.scores = (both.column(c).combine_chunks() for c in (group, f"{score}_max"))

    def candidates(table: pa.Table) -> pa.Table:
        plain = table
        for c in item:
            plain = plain.set_column(plain.schema.get_field_index(c), c, _comparable(plain.column(c)))
        if len(item) == len(names):
            return plain
        own = next(c for c in names if c not in item)
        found = plain.group_by(item, use_threads=False).aggregate([(own, "min")]).rename_columns([*item, own])
        return found.select(names).cast(table.schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = batch.column(2).type.value_type, batch.column(3).type.value_type
            for i in range(batch.num_rows):
                path, ks, gs, tops = (batch.column(c)[i] for c in range(4))
                reached = Reached(pa.array([], kinds[0]), pa.array([], kinds[1]))
                if batch.column(4)[i].is_valid:
                    reached = Reached(pa.array([gs.values[0].as_py()], kinds[0]), pa.array([batch.column(4)[i].as_py()], kinds[1]))
                row_group, band = ks.values.to_numpy(), batch.column(5)[i].values.to_numpy()
                bounds = np.flatnonzero(np.append(True, row_group[1:] != row_group[:-1])).tolist() + [len(row_group)]
                spans = pa.table({"a": bounds[:-1], "b": bounds[1:], "band": band[bounds[:-1]], "top": [pc.max(tops.values.slice(a, b - a)) for a, b in zip(bounds, bounds[1:])]})
                spans = spans.sort_by([("band", "ascending"), ("top", "descending"), ("a", "ascending")])
                fs, at = _open(path.as_py())
                held: pa.Table | None = None
                with fs.open_input_file(at) as source:
                    file = pq.ParquetFile(source)
                    for a, b in zip(spans["a"].to_pylist(), spans["b"].to_pylist()):
                        is_open = reached.open(gs.values.slice(a, b - a), tops.values.slice(a, b - a))
                        if not pc.any(is_open).as_py():
                            continue
                        table = file.read_row_group(int(row_group[a]), columns=names)
                        groups_read.add(1)
                        rows_read.add(table.num_rows)
                        table = table.filter(reached.open(table.column(group), table.column(score)))
                        if not table.num_rows:
                            continue
                        found = candidates(table)
                        held = candidates(pa.concat_tables([held, found])) if held is not None else found
                        reached.update(held)
                        held = held.filter(reached.open(held.column(group), held.column(score)))
                        if held.num_rows > _HELD:
                            yield from held.to_batches()
                            held = None
                if held is not None:
                    yield from held.to_batches()

    return work


class Clustered:
    """Rows in files clustered by group, with the index of their row groups; read any number of times."""

    def __init__(self, spark: SparkSession, path: str, index: Staged, group: str, score: str, schema):
        self.spark, self.path, self.index, self.group, self.score, self.schema = spark, path, index, group, score, schema
        #: Row groups and rows of the last ``top_n``, those read and all.
        self.report: dict[str, int] = {}

    def drop(self) -> None:
        Staged(self.spark, self.path).drop()
        self.index.drop()

    def top_n(self, n: int, *, then: Sequence[str] = (), unique_id: str, same: Sequence[str] = ()) -> DataFrame:
        """As :func:`top_n`, of rows that were clustered before."""
        group, score, context = self.group, self.score, self.spark.sparkContext
        names = list(dict.fromkeys([group, score, *then, *same, unique_id]))
        item = [c for c in names if c != unique_id] if same else names
        index, schema = self.index.df, self.spark.createDataFrame([], self.schema).select(*names).schema
        ranked = Window.partitionBy(group).orderBy(F.col(score).desc(), *[F.col(c).desc_nulls_last() for c in then], F.col(unique_id).asc())
        groups_read, rows_read = context.accumulator(0), context.accumulator(0)

        def best(rows: DataFrame) -> DataFrame:
            items = rows.groupBy(*item).agg(F.min(unique_id).alias(unique_id)) if same else rows
            return items.withColumn("_sl_rank", F.row_number().over(ranked)).where(F.col("_sl_rank") <= n).select(*names)

        def read(files: DataFrame, n_files: int) -> DataFrame:
            """Candidates of files (path, nth)."""
            entries = index.join(small_side(files, n_files), "path")
            columns = F.struct("row_group", F.col("top").alias("t"), "g", "band")
            per_file = entries.groupBy("path", "nth").agg(F.sort_array(F.collect_list(columns)).alias("x"))
            listed = per_file.select("path", F.col("x.row_group").alias("ks"), F.col("x.g").alias("gs"), F.col("x.t").alias("tops"), "nth", F.col("x.band").alias("bands"))
            spread = listed.repartition(max(1, min(n_files, 4 * context.defaultParallelism)), "path")
            return spread.mapInArrow(_reader(names, group, score, item, n, groups_read, rows_read), schema)

        files = index.groupBy("path").agg(F.min("g").alias("g"), F.max("g").alias("g_last"), F.max("top").alias("top"))
        # The files a group begins in hold its highest score; a file of one group that begins elsewhere waits.
        begins = Window.partitionBy("g").orderBy(F.col("top").desc(), "path")
        files = stage(files.withColumn("_sl_k", F.row_number().over(begins)), "files")
        only = (F.col("g") == F.col("g_last")) & (F.col("_sl_k") > 1)
        no_score = F.lit(None).cast(index.schema["top"].dataType).alias("nth")
        left, used = files.df.where(only).select("path", "g", "top"), [files]
        first = files.df.where(~only).select("path", no_score)
        now = stage(best(read(first, first.count())), "best")
        wave, waiting = 0, left.count()
        while waiting:
            wave += 1
            reached = now.df.groupBy(F.col(group).alias("g")).agg(F.min(score).alias("nth"), F.count("*").alias("have"))
            reached = reached.select("g", F.when(F.col("have") >= n, F.col("nth")).alias("nth"))
            still = left.join(reached, "g", "left").where(F.col("nth").isNull() | (F.col("top") >= F.col("nth")))
            # Where the N-th score isn't known yet, the next 2^wave files in descending order are enough for now.
            in_order = Window.partitionBy("g").orderBy(F.col("top").desc(), "path")
            ordered = still.withColumn("_sl_k", F.row_number().over(in_order))
            chosen = stage(ordered.where(F.col("nth").isNotNull() | (F.col("_sl_k") <= 2**wave)).select("path", "nth"), "wave")
            used.append(chosen)
            n_chosen = chosen.df.count()
            if not n_chosen:
                break
            was, now = now, stage(best(now.df.unionByName(read(chosen.df, n_chosen))), "best")
            was.drop()
            rest = stage(left.join(small_side(chosen.df.select("path"), n_chosen), "path", "left_anti"), "left")
            used.append(rest)
            left, waiting = rest.df, rest.df.count()
        whole = index.groupBy("path", "row_group").agg(F.sum("n").alias("n")).agg(F.count("*"), F.sum("n")).first()  # one row
        self.report = {"row_groups": whole[0], "row_groups_read": groups_read.value, "rows": whole[1] or 0, "rows_read": rows_read.value}
        for t in used:
            t.drop()
        return now.df


def cluster_by_group(
    df: DataFrame, group: str, score: str, ties: Sequence[str] = (), *, first_band: int = FIRST_BAND, row_group_rows: int = ROW_GROUP_ROWS
) -> Clustered:
    """Writes rows with a non-null group and a score in files of ranges of (group, score descending, ties).

    ``ties`` spread equal scores of one group over several files. Null and NaN scores are left out. Group
    and score may have any atomic type that has an order; the index keeps their types. A task holds at
    most one row group of each band, and a group of r rows has about log2(r / ``first_band``) bands.
    """
    spark = df.sparkSession
    has_score = F.col(score).isNotNull()
    if df.schema[score].dataType.typeName() in ("float", "double"):
        has_score &= ~F.isnan(score)
    rows = df.where(F.col(group).isNotNull() & has_score)
    order = [F.col(group), F.col(score).desc(), *[F.col(t) for t in ties]]
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order[:2])
    folder = f"{shared_dir(spark)}/clustered-{uuid.uuid4().hex}"
    kinds = {c: df.schema[c].dataType.simpleString() for c in (group, score)}
    written = ranges.mapInArrow(
        _writer(folder, group, score, first_band, row_group_rows), f"path string, row_group int, band int, g {kinds[group]}, top {kinds[score]}, n bigint"
    )
    return Clustered(spark, folder, stage(written, "row-groups"), group, score, df.schema)


def top_n(df: DataFrame, n: int, group: str, score: str, *, then: Sequence[str] = (), unique_id: str, same: Sequence[str] = ()) -> DataFrame:
    """The first n items of every group by score descending, ``then`` descending with nulls last, ``unique_id`` ascending.

    ``same`` names columns that identify an item: rows equal in them (null equals null, NaN equals NaN)
    are one item, whose id is the smallest. Rows whose group is null or whose score is null or NaN do not
    count; the caller filters other scores. Groups with fewer than n items come out whole. An empty table
    gives no rows. Returns group, score, then, unique_id and the columns of ``same``.

    The rows are shuffled and written once to be clustered; for several questions to the same rows use
    :func:`cluster_by_group` and its ``top_n``.
    """
    names = list(dict.fromkeys([group, score, *then, *same, unique_id]))
    ties = [*then, *[c for c in same if c not in (group, score, *then)], unique_id]
    clustered = cluster_by_group(df.select(*names), group, score, ties)
    best = clustered.top_n(n, then=then, unique_id=unique_id, same=same)
    clustered.drop()
    return best
