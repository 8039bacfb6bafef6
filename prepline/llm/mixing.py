"""Mixing sources of documents to target weights within a budget of tokens."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prepline.llm.bpe import DEFAULT_VOCABULARY
from prepline.llm.encoding import token_count
from prepline.session import cut

#: Documents that one range of a source holds on average if all documents are of one source.
RANGE_ROWS = 8192
#: Tokens of a block, by which the lines of a mix find the documents they take; blocks of a source that would have
#: more than ``BLOCKS`` of them are longer.
BLOCK_TOKENS, BLOCKS = 32768, 65536


@dataclass(frozen=True)
class Mix:
    """``picks``: mix_id, source_name, doc_id, n_tokens, copies. ``report``: one row per line, see ``mix_sources``."""

    picks: DataFrame
    report: DataFrame


def order_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Every document with tokens at its place in a random order of its source, and the totals of the sources.

    Returns (doc_id, source_name, n_tokens, start_token, place: the documents before it) and (source_name,
    source_tokens). The random key of a
    document is a hash of its id (of documents without id a hash of their place), and a source is cut into ranges
    of that key, so that a source that holds most of the rows is spread over many tasks: only the sums of its
    ranges pass through one window.
    """
    own = F.col(f"`{id_col}`")
    key = F.xxhash64(F.lit(seed), own, F.when(own.isNull(), F.monotonically_increasing_id())).alias("key")
    counted = docs.select(own.alias("doc_id"), key, F.col(f"`{source_col}`").alias("source_name"), token_count(F.col(f"`{text_col}`"), vocabulary).alias("n_tokens")).where("source_name is not null")
    sized = cut(counted).where("n_tokens > 0")  # filtered after it is written, else texts would be encoded twice
    bits = max(0, math.ceil(math.log2(max(1, sized.count()) / RANGE_ROWS)))
    keyed = sized.withColumn("range", F.shiftright("key", 63 - bits) if bits else F.lit(0).cast("bigint"))
    sums = keyed.groupBy("source_name", "range").agg(F.sum("n_tokens").alias("range_tokens"), F.count(F.lit(1)).alias("range_docs"))
    by_source = Window.partitionBy("source_name").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source_name", "range", *[F.coalesce(F.sum(f"range_{c}").over(by_source), F.lit(0)).alias(f"{c}_before") for c in ("tokens", "docs")])
    in_range = Window.partitionBy("source_name", "range").orderBy("key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        keyed.withColumns({"t": F.coalesce(F.sum("n_tokens").over(in_range), F.lit(0)), "d": F.count(F.lit(1)).over(in_range)})
        .join(starts, ["source_name", "range"])
        .select("doc_id", "source_name", "n_tokens", (F.col("tokens_before") + F.col("t")).alias("start_token"), (F.col("docs_before") + F.col("d")).alias("place"))
    )
    return placed, sums.groupBy("source_name").agg(F.sum("range_tokens").alias("source_tokens"), F.sum("range_docs").alias("source_docs"))


def mix_sources(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY, seed: int = 42) -> Mix:
    """Picks documents so that each source of a mix has its share of the mix's budget of tokens.

    ``targets`` has mix_id, source_name, weight, max_repeats, budget_tokens. A line's target is weight / (sum of
    the mix's weights) * budget_tokens. The documents of a source stand in one random order; a line takes as many
    whole rounds of its source as fit into the target (at most max_repeats, null: 1) and then the documents that
    end within what is left, so it never exceeds its target and misses it by less than one document, unless the
    source is short.

    The report has mix_id, source_name, target_tokens, source_tokens, available_tokens (source_tokens *
    max_repeats), picked_tokens, picked_docs (copies count), target_share, actual_share (null for a mix without
    picks) and short: the source's documents can't fill the target.

    Defined cases: null or negative weights count as 0, a null budget as 0, max_repeats under 1 as 0; repeated
    lines of a mix and source are one line with the sum of the weights and the largest max_repeats; a mix whose
    weights add up to 0 has targets of 0; documents with null source or no tokens are in no mix. Every row of the
    documents counts, also one with a repeated or null id; texts may have any length. Without documents every line
    with a target is short; without targets the report is empty. Other columns are ignored, whatever their names.
    """
    return mix_placed(*order_sources(docs, id_col, source_col, text_col, vocabulary, seed), targets)


def _block_tokens() -> Column:
    """Tokens of a block of the row's source: no source has more than ``BLOCKS`` of them, whatever its size."""
    return F.greatest(F.lit(BLOCK_TOKENS).cast("bigint"), F.ceil(F.col("source_tokens") / BLOCKS))


def mix_placed(placed: DataFrame, totals: DataFrame, targets: DataFrame) -> Mix:
    """``mix_sources`` of documents that are in order already (the two tables of ``order_sources``).

    The report needs no picks: a line ends in the one document that holds its last token, which is found by a join
    on source and block with at most one match, and whose place and start are the picked documents and tokens.
    """
    mix = Window.partitionBy("mix_id")
    lines = (
        targets.groupBy("mix_id", "source_name")
        .agg(
            F.sum(F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))).alias("weight"),
            F.greatest(F.max(F.coalesce("max_repeats", F.lit(1))), F.lit(0)).cast("bigint").alias("max_repeats"),
            F.max(F.coalesce("budget_tokens", F.lit(0))).alias("budget_tokens"),
        )
        .withColumn("weights", F.sum("weight").over(mix))
        .withColumn("target_share", F.when(F.col("weights") > 0, F.try_divide("weight", "weights")).otherwise(0.0))
        .withColumn("target_tokens", F.col("target_share") * F.col("budget_tokens"))
        .join(totals, "source_name", "left")
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("source_tokens", "source_docs")})
        .withColumn("available_tokens", F.col("source_tokens") * F.col("max_repeats"))
        .withColumn("rounds", F.least("max_repeats", F.floor(F.coalesce(F.try_divide("target_tokens", "source_tokens"), F.lit(0.0)))))
        .withColumn("rest", F.when(F.col("rounds") < F.col("max_repeats"), F.col("target_tokens") - F.col("rounds") * F.col("source_tokens")).otherwise(0.0))
    )
    step = _block_tokens()
    blocked = placed.join(totals, "source_name").withColumn("block", F.floor(F.col("start_token") / step))
    reach = F.when(F.col("rounds") > 0, F.col("source_tokens").cast("double")).otherwise(F.least("rest", F.col("source_tokens").cast("double")))
    wanted = lines.where((F.col("rounds") > 0) | (F.col("rest") >= 1)).select("mix_id", "source_name", "rounds", "rest", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(reach / step))).alias("block"))
    fits = F.col("start_token") + F.col("n_tokens") <= F.col("rest")
    picks = (
        blocked.join(wanted, ["source_name", "block"])
        .select("mix_id", "source_name", "doc_id", "n_tokens", (F.col("rounds") + F.when(fits, 1).otherwise(0)).alias("copies"))
        .where("copies > 0")
    )
    partly = lines.where((F.col("rest") >= 1) & (F.col("rest") < F.col("source_tokens"))).select("mix_id", "source_name", "rest", F.floor(F.col("rest") / step).alias("block"))
    over = blocked.select("source_name", "start_token", "n_tokens", "place", F.explode(F.sequence("block", F.floor((F.col("start_token") + F.col("n_tokens") - 1) / step))).alias("block"))
    ends = (
        over.join(partly, ["source_name", "block"])
        .where((F.col("start_token") <= F.col("rest")) & (F.col("rest") < F.col("start_token") + F.col("n_tokens")))
        .select("mix_id", "source_name", "start_token", "place")
    )
    rest_of = lambda whole, part: F.when(F.col("rest") < 1, 0).when(F.col("rest") >= F.col("source_tokens"), F.col(whole)).otherwise(F.coalesce(F.col(part), F.lit(0)))
    report = (
        lines.alias("l")
        .join(ends.alias("t"), F.col("l.mix_id").eqNullSafe(F.col("t.mix_id")) & (F.col("l.source_name") == F.col("t.source_name")), "left")
        .select("l.*", "start_token", "place")
        .withColumn("picked_tokens", F.col("rounds") * F.col("source_tokens") + rest_of("source_tokens", "start_token"))
        .withColumn("picked_docs", F.col("rounds") * F.col("source_docs") + rest_of("source_docs", "place"))
        .withColumn("actual_share", F.try_divide(F.col("picked_tokens"), F.sum("picked_tokens").over(mix)))
        .withColumn("short", (F.col("picked_tokens") == F.col("available_tokens")) & (F.col("available_tokens") < F.col("target_tokens")))
        .select("mix_id", "source_name", "target_tokens", "source_tokens", "available_tokens", "picked_tokens", "picked_docs", "target_share", "actual_share", "short")
    )
    return Mix(picks, report)
