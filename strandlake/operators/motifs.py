"""Scoring matrices for short motifs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions.sequence import consensus_pattern

LETTERS = "ACGT"


def log_odds(counts: np.ndarray, background: Sequence[float] | None = None, correction: float = 1e-10) -> np.ndarray:
    """log2 of frequency over background, for rows of counts of A, C, G, T."""
    c = np.asarray(counts, float)
    back = np.full(c.shape[1], 1 / c.shape[1]) if background is None else np.asarray(background, float)
    freq = (c + correction) / (c + correction).sum(1, keepdims=True)
    return np.log2(freq) - np.log2(back)


def stormo_scores(counts: np.ndarray, background: Sequence[float] | None = None) -> np.ndarray:
    """log2 of (count + background) / (total + 1) over background."""
    c = np.asarray(counts, float)
    back = np.full(c.shape[1], 1 / c.shape[1]) if background is None else np.asarray(background, float)
    return np.log2((c + back) / (c.sum(1, keepdims=True) + 1) / back)


def reverse_complement(matrix: np.ndarray) -> np.ndarray:
    return np.asarray(matrix)[::-1, ::-1]


def information(counts: np.ndarray) -> np.ndarray:
    """Bits of every row: 2 minus its entropy."""
    f = np.asarray(counts, float)
    f = f / f.sum(1, keepdims=True)
    return 2 + np.where(f > 0, f * np.log2(np.where(f > 0, f, 1)), 0).sum(1)


def scaled(matrix: np.ndarray, score: float) -> float:
    """A score as a share of the way from the lowest to the highest possible one."""
    low, high = matrix.min(1).sum(), matrix.max(1).sum()
    return float((score - low) / (high - low))


def correlation(a: np.ndarray, b: np.ndarray) -> float:
    """Mean correlation of the rows of two matrices of one shape."""
    return float(np.mean([np.corrcoef(x, y)[0, 1] if x.std() and y.std() else 0.0 for x, y in zip(a, b)]))


def slide_correlation(a: np.ndarray, b: np.ndarray) -> list[float]:
    """Correlation at each place of the shorter matrix along the longer one."""
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    return [correlation(a[i : i + len(b)], b) for i in range(len(a) - len(b) + 1)]


def score_text(matrix: np.ndarray, text: str, gaps: bool = False) -> np.ndarray:
    """Score of the window that begins at each position; NaN where none fits or a letter is unknown.

    With ``gaps`` windows skip gap characters and begin at letters only.
    """
    table = np.full(256, -1)
    for i, c in enumerate(LETTERS):
        table[[ord(c), ord(c.lower())]] = i
    code = table[np.frombuffer(text.encode("ascii", "replace"), "u1")]
    at = np.flatnonzero(np.frombuffer(text.encode("ascii", "replace"), "u1") != ord("-")) if gaps else np.arange(len(code))
    out, k, n = np.full(len(code), np.nan), len(matrix), len(at) - len(matrix) + 1
    if n > 0:
        windows = np.lib.stride_tricks.sliding_window_view(code[at], k)
        scores = np.asarray(matrix)[np.arange(k), windows].sum(1)
        out[at[:n]] = np.where((windows >= 0).all(1), scores, np.nan)
    return out


def hits(df: DataFrame, keys: Sequence[str], text: str, matrix: np.ndarray, threshold: float, *, both_strands: bool = False, gaps: bool = False) -> DataFrame:
    """keys, col, strand, score of every window that scores at least the threshold. Null texts have none."""
    forms = [("+", np.asarray(matrix, float))] + ([("-", reverse_complement(matrix))] if both_strands else [])
    names = [f"_sl_{i}" for i in range(len(keys))]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                for strand, m in forms:
                    scores = score_text(m, row[-1], gaps)
                    at = np.flatnonzero(scores >= threshold)
                    out += [(*row[:-1], int(i), strand, float(scores[i])) for i in at]
            yield pd.DataFrame(out, columns=[*names, "col", "strand", "score"])

    kinds = ", ".join(f"{n} {df.schema[k].dataType.simpleString()}" for n, k in zip(names, keys))
    rows = df.where(F.col(text).isNotNull()).select(*[F.col(k).alias(n) for n, k in zip(names, keys)], F.col(text))
    return rows.mapInPandas(work, f"{kinds}, col bigint, strand string, score double").withColumnsRenamed(dict(zip(names, keys)))


def exact_hits(df: DataFrame, keys: Sequence[str], text: str, codes: str) -> DataFrame:
    """keys, col of every place at which an ambiguity-code motif begins (overlapping ones too), case ignored."""
    n = len(codes)
    marked = F.regexp_replace(F.upper(F.col(text)), f"(?={consensus_pattern(codes)})", "!")
    # Each mark stands before a hit; those before it shift it by one each.
    parts = F.split(marked, "!", -1)
    lengths = F.transform(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.length(p).cast("bigint"))
    sums = F.aggregate(lengths, F.array().cast("array<bigint>"), lambda s, v: F.concat(s, F.array(F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0)) + v)))
    return df.where(F.length(text) >= n).select(*keys, F.explode(sums).alias("col"))


def row_scores(df: DataFrame, keys: Sequence[str], text: str, matrix: np.ndarray, *, both_strands: bool = True, mask: str = "#*") -> DataFrame:
    """keys, scores: for every column of an aligned text the best score (of both strands) of the window of bases that begins there.

    Windows skip gaps; columns with a gap, a masked or an unknown letter in their window have a null score.
    """
    forms = [np.asarray(matrix, float)] + ([reverse_complement(matrix)] if both_strands else [])
    hide = str.maketrans(dict.fromkeys(mask, "N"))
    names = [f"_sl_{i}" for i in range(len(keys))]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            best = [np.max([score_text(m, t.translate(hide), True) for m in forms], axis=0) for t in batch["_sl_text"]]
            lists = [[None if np.isnan(v) else float(v) for v in b] for b in best]
            yield batch.drop(columns="_sl_text").assign(scores=lists)

    kinds = ", ".join(f"{n} {df.schema[k].dataType.simpleString()}" for n, k in zip(names, keys))
    rows = df.where(F.col(text).isNotNull()).select(*[F.col(k).alias(n) for n, k in zip(names, keys)], F.col(text).alias("_sl_text"))
    return rows.mapInPandas(work, f"{kinds}, scores array<double>").withColumnsRenamed(dict(zip(names, keys)))
