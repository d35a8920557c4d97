"""Mapping intervals through chains of gap-free blocks.

Chain blocks are rows of (chain_id, score, t_name, t_start, t_end, q_name, q_start, q_strand, q_size):
target positions [t_start, t_end) lie at q_start and on, on strand q_strand of the query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.operators import ranges as R


def chain_blocks(chains: DataFrame) -> DataFrame:
    """Blocks of chains with arrays ``sizes``, ``dt``, ``dq`` (one entry fewer or 0 at the end)."""
    steps = F.arrays_zip(F.col("sizes").alias("z"), F.col("dt").alias("dt"), F.col("dq").alias("dq"))
    head = ["chain_id", "score", "t_name", "q_name", "q_strand", "q_size"]
    each = chains.select(*head, "t_start", "q_start", F.posexplode(steps).alias("block_no", "b"))
    before = Window.partitionBy("chain_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    gone = lambda gap: F.coalesce(F.sum(F.col("b.z") + F.coalesce(F.col(f"b.{gap}"), F.lit(0))).over(before), F.lit(0))
    at = each.withColumns({"t": F.col("t_start") + gone("dt"), "q": F.col("q_start") + gone("dq")})
    return at.select(*head, "block_no", F.col("t").alias("t_start"), (F.col("t") + F.col("b.z")).alias("t_end"), F.col("q").alias("q_start"))


def map_pieces(elements: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """key, chain_id, block_no, q_name and forward query range of each part of an element in a block."""
    named = blocks.select(
        F.col("t_name").alias(R.CHROM), F.col("t_start").alias(R.START), F.col("t_end").alias(R.END), "chain_id", "score", "block_no", "q_name",
        "q_strand", "q_size", F.col("q_start").alias("q0"),
    )
    p = R.overlap_pairs(elements.select(key, R.CHROM, R.START, R.END), named, bring=["chain_id", "score", "block_no", "q_name", "q_strand", "q_size", "q0"])
    low = F.col("b_q0") + F.greatest(R.START, f"b_{R.START}") - F.col(f"b_{R.START}")
    high = low + F.col("overlap")
    minus = F.col("b_q_strand") == "-"
    return p.select(
        key, F.col("b_chain_id").alias("chain_id"), F.col("b_score").alias("score"), F.col("b_block_no").alias("block_no"), F.col("b_q_name").alias(R.CHROM),
        F.when(minus, F.col("b_q_size") - high).otherwise(low).alias(R.START), F.when(minus, F.col("b_q_size") - low).otherwise(high).alias(R.END),
        "overlap",
    )


def liftover(elements: DataFrame, blocks: DataFrame, key: str, *, max_gap: int | None = None, threshold: float = 0.0, keep_split: bool = False) -> DataFrame:
    """key, chain_id, chrom, start, end, n_blocks, mapped of the elements that map.

    An element maps through a chain unless two of its neighbouring parts there are more than ``max_gap``
    apart. Elements on several chains are dropped, or go through the one that maps most bases (ties: higher score,
    smaller id) if ``keep_split``. Less than ``threshold`` of the element mapped drops it.
    """
    pieces = map_pieces(elements, blocks, key)
    along = Window.partitionBy(key, "chain_id").orderBy(R.START)
    gap = pieces.withColumn("_sl_gap", F.col(R.START) - F.lag(R.END).over(along))
    per_chain = gap.groupBy(key, "chain_id", R.CHROM).agg(
        F.max("score").alias("score"), F.min(R.START).alias(R.START), F.max(R.END).alias(R.END), F.count("*").alias("n_blocks"),
        F.sum("overlap").alias("mapped"), F.max("_sl_gap").alias("_sl_gap"),
    )
    if max_gap is not None:
        per_chain = per_chain.where(F.coalesce(F.col("_sl_gap"), F.lit(0)) <= max_gap)
    best = Window.partitionBy(key).orderBy(F.col("mapped").desc(), F.col("score").desc(), "chain_id")
    ranked = per_chain.withColumns({"_sl_k": F.row_number().over(best), "_sl_n": F.count("*").over(Window.partitionBy(key))})
    one = ranked.where(F.col("_sl_k") == 1) if keep_split else ranked.where(F.col("_sl_n") == 1)
    width = elements.select(key, (F.col(R.END) - F.col(R.START)).alias("_sl_width"))
    kept = one.join(width, key).where(F.col("mapped") >= F.col("_sl_width") * threshold)
    return kept.select(key, "chain_id", R.CHROM, R.START, R.END, "n_blocks", "mapped")


def chain_side(chains: DataFrame, side: str, *, forward: bool = False) -> DataFrame:
    """chrom, start_pos, end_pos, name (the chain's id), score, strand of the target's (``t``) or query's (``q``) side of chains.

    ``forward`` counts positions from the forward strand's beginning whatever the strand.
    """
    start, end, size = (F.col(f"{side}_{c}") for c in ("start", "end", "size"))
    turned = F.lit(forward) & (F.col(f"{side}_strand") == "-")
    return chains.select(
        F.col(f"{side}_name").alias("chrom"), F.when(turned, size - end).otherwise(start).alias("start_pos"), F.when(turned, size - start).otherwise(end).alias("end_pos"),
        F.col("chain_id").cast("string").alias("name"), "score", F.col(f"{side}_strand").alias("strand"),
    )
