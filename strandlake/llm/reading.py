"""Reading level of the prose each message's sender wrote.

Documents and words form a graph: a document is joined to each of its words, by the logarithm of the
word's count over the document's sum of them, so every document weighs the same. Graded documents are
clamped to their grade; in harmonic iterations every word takes the weighted mean of its documents and
every other document the mean of its words, until no word moves by more than a tolerance. Harmonic
values flatten towards the mean of their surroundings (a language, a topic), so levels are told apart
by cuts that are carried over the same graph: the graded documents' own scores, their own grade left
out, are averaged by grade over their words, and each document takes the means its words have.
"""

from __future__ import annotations

import warnings
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.mail import own_words
from strandlake.session import Staged, small_side, stage

#: Buckets words are hashed into by default: vectors of this length are sent to the tasks.
BUCKETS = 2**18
MIN_WORDS = 40
#: Largest change of a word's value, in grades, at which the iterations end, and their greatest number.
TOLERANCE, MOST_ITERATIONS = 0.01, 200
#: Weight of an ungraded document beside a graded one in a word's mean; 1 is the harmonic iteration, 0 switches propagation off.
UNGRADED = 1.0


def _features(names: list[str], min_words: int, buckets: int | None):
    kind = pa.string() if buckets is None else pa.int32()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                keep, n, sizes, nodes, counts = [], [], [0], [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    words = own_words(text) if text else []
                    if len(words) < min_words:
                        continue
                    seen: Counter = Counter(words if buckets is None else (zlib.crc32(w.encode()) % buckets for w in words))
                    keep.append(i)
                    n.append(len(words))
                    nodes += seen.keys()
                    counts += seen.values()
                    sizes.append(len(nodes))
                offsets = pa.array(sizes, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(keep, pa.int64())), pa.array(n, pa.int64())]
                    + [pa.ListArray.from_arrays(offsets, pa.array(v, t)) for v, t in ((nodes, kind), (counts, pa.int32()))],
                    names=names,
                )

    return work


class _Batch:
    """Edges of a batch of (grade, words, counts): row, bucket and weight of each, and the rows' grades (0: none)."""

    def __init__(self, batch: pa.RecordBatch):
        self.n = batch.num_rows
        self.grade = batch.column(0).cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False)
        self.graded = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
        lists, counts = batch.column(1), batch.column(2)
        self.row = np.repeat(np.arange(self.n), np.diff(lists.offsets.to_numpy()))
        self.bucket = lists.flatten().to_numpy()
        weight = np.log1p(counts.flatten().to_numpy())
        self.weight = weight / np.bincount(self.row, weight, self.n)[self.row]

    def mean(self, value: np.ndarray, has: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's weighted mean of its edges' values where they have one, and whether any has."""
        weight = np.where(has, self.weight, 0.0)
        total = np.bincount(self.row, weight, self.n)
        return np.bincount(self.row, weight * np.where(has, value, 0.0), self.n) / np.where(total > 0, total, 1), total > 0

    def harmonic(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        value = words[self.bucket]
        return self.mean(value, ~np.isnan(value))

    def scores(self, value: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows' harmonic values; a graded row's own grade is taken out of its words first."""
        own = self.weight * self.graded[self.row]
        rest = total[self.bucket] - own
        has = rest > 1e-9 * total[self.bucket]
        return self.mean((value[self.bucket] - own * self.grade[self.row]) / np.where(has, rest, 1.0), has)


def _word_sums(words, ungraded: float, buckets: int):
    """Per task: the weighted sum of document values and the weights for every bucket."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, total = np.zeros(buckets), np.zeros(buckets)
        for batch in batches:
            b = _Batch(batch)
            own, share = b.grade, b.graded.astype(float)
            if words is not None:
                mean, has = b.harmonic(words.value)
                own = np.where(b.graded, b.grade, mean)
                share = np.where(b.graded, 1.0, ungraded * has)
            edge = b.weight * share[b.row]
            value += np.bincount(b.bucket, edge * own[b.row], buckets)
            total += np.bincount(b.bucket, edge, buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype("int32")), pa.array(value[at]), pa.array(total[at])], names=["bucket", "value", "total"])

    return work


def _grade_sums(sums, buckets: int):
    """Per task and grade: sums of the graded documents' scores and of weights for every bucket; bucket -1 is all of them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[float, np.ndarray] = {}
        for batch in batches:
            b = _Batch(batch)
            score, has = b.scores(*sums.value)
            for g in np.unique(b.grade[has]).tolist():
                rows = has & (b.grade == g)
                edge = np.where(rows[b.row], b.weight, 0.0)
                own = found.setdefault(g, np.zeros((2, buckets + 1)))
                own[0, :-1] += np.bincount(b.bucket, edge * score[b.row], buckets)
                own[1, :-1] += np.bincount(b.bucket, edge, buckets)
                own[0, -1] += score[rows].sum()
                own[1, -1] += rows.sum()
        for g, own in found.items():
            at = np.flatnonzero(own[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), g).astype("int32")), pa.array(np.where(at < buckets, at, -1).astype("int32")), pa.array(own[0][at]), pa.array(own[1][at])],
                names=["grade", "bucket", "value", "total"],
            )

    return work


def _levels(model, names: list[str]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, grades, means, whole = model.value
        for batch in batches:
            b = _Batch(batch.select(["_sl_grade", "words", "counts"]))
            score, has = b.scores(*sums)
            local = []
            for k in range(len(grades)):
                value = means[k][b.bucket]
                mean, any_ = b.mean(value, ~np.isnan(value))
                local.append(np.where(any_, mean, whole[k]))
            above = sum((score > (low + high) / 2).astype(int) for low, high in zip(local, local[1:])) if len(grades) > 1 else np.zeros(b.n, int)
            level = np.array(grades, "int32")[np.where(has, above, len(grades) // 2)]
            level = np.where(b.graded, b.grade, level).astype("int32")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, mask=~has), pa.array(level)], names=names)

    return work


def _hashed(nodes: Staged, key: str, grade: str, kind: str, buckets: int, tolerance: float, most: int, ungraded: float) -> DataFrame | None:
    """Levels with the words' side as vectors of ``buckets`` values; None without graded documents."""
    context = nodes.spark.sparkContext
    # Each task emits up to ``buckets`` sums: one task a core is enough, however many files there are.
    few = nodes.df.select("_sl_grade", "words", "counts").coalesce(context.defaultParallelism)

    def vectors(table: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray]:
        value, total, at = np.zeros(size), np.zeros(size), table.column("bucket").to_numpy()
        value[at], total[at] = table.column("value").to_numpy(), table.column("total").to_numpy()
        return value, total

    words, before, sums = None, None, None
    for k in range(most):
        table = (
            few.mapInArrow(_word_sums(words, ungraded, buckets), "bucket int, value double, total double")
            .groupBy("bucket").agg(F.sum("value").alias("value"), F.sum("total").alias("total")).toArrow()  # at most ``buckets`` rows
        )
        if not table.num_rows:
            return None
        sums = vectors(table, buckets)
        now = np.where(sums[1] > 0, sums[0] / np.where(sums[1] > 0, sums[1], 1), np.nan)
        if words is not None:
            words.unpersist()
        if not ungraded or (before is not None and _settled(before, now, tolerance)):
            break
        words, before = context.broadcast(now), now
    else:
        warnings.warn(f"reading levels: not settled to {tolerance} after {most} iterations", stacklevel=2)
    shared = context.broadcast(sums)
    rows = (
        few.where("_sl_grade is not null").mapInArrow(_grade_sums(shared, buckets), "grade int, bucket int, value double, total double")
        .groupBy("grade", "bucket").agg(F.sum("value").alias("value"), F.sum("total").alias("total")).toArrow()  # at most ``buckets`` + 1 rows a grade
    )
    of = rows.column("grade").to_numpy()
    means, whole, grades = [], [], sorted(set(of.tolist()))
    for g in grades:
        value, total = vectors(rows.filter(pa.array(of == g)), buckets + 1)
        mean = np.where(total > 0, value / np.where(total > 0, total, 1), np.nan)
        means.append(mean[:-1])
        whole.append(float(mean[-1]))
    shared.unpersist()
    if not grades:  # no graded document shares a word with another one
        grades = sorted(r[0] for r in nodes.df.where("_sl_grade is not null").select("_sl_grade").distinct().collect())  # the grades
        means, whole = [np.full(buckets, np.nan)] * len(grades), [float(g) for g in grades]
    model = context.broadcast((sums, grades, means, whole))
    return nodes.df.select(key, "n_words", "_sl_grade", "words", "counts").mapInArrow(
        _levels(model, [key, "n_words", "difficulty", grade]), f"`{key}` {kind}, n_words bigint, difficulty double, `{grade}` int"
    )


def _settled(before: np.ndarray, now: np.ndarray, tolerance: float) -> bool:
    same = np.isnan(before) == np.isnan(now)
    return bool(same.all()) and (np.isnan(now).all() or float(np.nanmax(np.abs(now - before))) <= tolerance)


def _exact(nodes: Staged, key: str, grade: str, tolerance: float, most: int, ungraded: float) -> DataFrame | None:
    """The same with a table of words joined to the edges, for vocabularies of any size."""
    used: list[Staged] = []
    grades = sorted(r[0] for r in nodes.df.where("_sl_grade is not null").select("_sl_grade").distinct().collect())  # the grades
    if not grades:
        return None
    size = F.aggregate("counts", F.lit(0.0), lambda a, c: a + F.log1p(c))
    edges = nodes.df.withColumn("_sl_size", size).select(
        "_sl_row", "_sl_grade", F.explode(F.arrays_zip("words", "counts")).alias("x"), "_sl_size"
    ).select("_sl_row", "_sl_grade", F.col("x.words").alias("word"), (F.log1p("x.counts") / F.col("_sl_size")).alias("e"))
    edges = stage(edges, "edges")
    used.append(edges)

    def keep(df: DataFrame, tag: str) -> Staged:
        used.append(stage(df, tag))
        return used[-1]

    def mean(value: Column) -> Column:
        return F.sum(F.when(value.isNotNull(), F.col("e") * value)) / F.sum(F.when(value.isNotNull(), F.col("e")))

    def on_words(words: Staged) -> DataFrame:
        return edges.df.join(small_side(words.df, words.df.count()), "word", "left")

    values: DataFrame | None = None
    words: Staged | None = None
    for k in range(most):
        shares = edges.df.withColumns({"own": F.col("_sl_grade").cast("double"), "share": F.when(F.col("_sl_grade").isNotNull(), F.lit(1.0))})
        if values is not None:
            shares = edges.df.join(values, "_sl_row").withColumns(
                {"own": F.coalesce(F.col("_sl_grade").cast("double"), "mean"), "share": F.when(F.col("_sl_grade").isNotNull(), 1.0).when(F.col("mean").isNotNull(), F.lit(ungraded))}
            )
        edge = F.col("e") * F.col("share")
        sums = shares.groupBy("word").agg(F.sum(edge * F.col("own")).alias("value"), F.sum(edge).alias("total")).where("total > 0")
        before, words = words, keep(sums, "words")
        if not ungraded:
            break
        if before is not None:
            both = before.df.select("word", (F.col("value") / F.col("total")).alias("a")).join(
                words.df.select("word", (F.col("value") / F.col("total")).alias("b")), "word", "full_outer"
            )
            moved = F.max(F.coalesce(F.abs(F.col("a") - F.col("b")), F.lit(float("inf"))))
            if (both.agg(moved).first()[0] or 0.0) <= tolerance:  # one row
                break
        values = keep(on_words(words).groupBy("_sl_row").agg(mean(F.col("value") / F.col("total")).alias("mean")), "values").df
    else:
        warnings.warn(f"reading levels: not settled to {tolerance} after {most} iterations", stacklevel=2)
    own = F.when(F.col("_sl_grade").isNotNull(), F.col("e")).otherwise(0.0)
    rest = F.col("total") - own
    apart = F.when(rest > 1e-9 * F.col("total"), (F.col("value") - own * F.coalesce("_sl_grade", F.lit(0))) / rest)
    scores = keep(on_words(words).groupBy("_sl_row").agg(mean(apart).alias("difficulty")), "scores")
    graded = edges.df.where("_sl_grade is not null").join(scores.df.where("difficulty is not null"), "_sl_row")
    local = keep(graded.groupBy("word").pivot("_sl_grade", grades).agg(F.sum(F.col("e") * F.col("difficulty")) / F.sum("e")), "means")
    whole = nodes.df.join(scores.df, "_sl_row").where("_sl_grade is not null").groupBy("_sl_grade").agg(F.avg("difficulty")).collect()  # a row a grade
    whole = {g: m for g, m in whole if m is not None}
    known = [g for g in grades if g in whole] or grades
    cuts = keep(on_words(local).groupBy("_sl_row").agg(*[F.coalesce(mean(F.col(str(g))), F.lit(whole.get(g, float(g)))).alias(f"m{i}") for i, g in enumerate(known)]), "cuts")
    above = F.lit(0)
    for i in range(len(known) - 1):
        above = above + (F.col("difficulty") > (F.col(f"m{i}") + F.col(f"m{i + 1}")) / 2).cast("int")
    level = F.element_at(F.array(*[F.lit(g) for g in known]), F.when(F.col("difficulty").isNull(), len(known) // 2).otherwise(above) + 1)
    out = nodes.df.join(scores.df, "_sl_row").join(cuts.df, "_sl_row").select(key, "n_words", "difficulty", F.coalesce("_sl_grade", level).alias(grade))
    out = stage(out, "levels").df
    for t in used:
        t.drop()
    return out


def reading_levels(
    docs: DataFrame, graded: DataFrame, key: str = "doc_id", text: str = "text", grade: str = "read_level", *,
    min_words: int = MIN_WORDS, buckets: int | None = BUCKETS, tolerance: float = TOLERANCE, most_iterations: int = MOST_ITERATIONS,
    ungraded: float = UNGRADED,
) -> DataFrame:
    """key, n_words, difficulty, grade of every document whose sender's own prose has ``min_words`` words.

    Whether a document comes out is decided by its text alone. Graded documents keep their grade (the
    largest, if there are several; null grades do not count). ``difficulty`` is the harmonic value, for a
    graded document the one its words have without it. Documents without a word that any graded document
    reaches have a null difficulty and the middle grade. Null and empty texts don't come out. Without
    graded documents that have prose there are no rows. Keys are taken to be unique; columns other than
    those named are not read. Grades are few whole numbers.

    Words are hashed into ``buckets``; words that share one are one word. ``buckets=None`` is the exact
    way for any vocabulary: a table of words is joined instead.
    """
    kind = docs.schema[key].dataType.simpleString()
    word = "string" if buckets is None else "int"
    found = docs.select(F.col(key), F.col(text).cast("string").alias("_sl_text")).mapInArrow(
        _features([key, "n_words", "words", "counts"], min_words, buckets), f"`{key}` {kind}, n_words bigint, words array<{word}>, counts array<int>"
    )
    known = graded.where(F.col(grade).isNotNull()).groupBy(key).agg(F.max(F.col(grade).cast("int")).alias("_sl_grade"))
    nodes = stage(found.join(small_side(known, known.count()), key, "left").withColumn("_sl_row", F.monotonically_increasing_id()), "reading")
    if buckets is None:
        levels = _exact(nodes, key, grade, tolerance, most_iterations, ungraded)
    else:
        levels = _hashed(nodes, key, grade, kind, buckets, tolerance, most_iterations, ungraded)
    if levels is None:
        return nodes.df.where("false").select(key, "n_words", F.lit(None).cast("double").alias("difficulty"), F.lit(0).alias(grade))
    out = stage(levels, "scores").df
    nodes.drop()
    return out
