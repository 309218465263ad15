"""Mixing documents of several sources to target shares of all tokens.

Each source gets a number of expected copies per document, at most its cap. Documents of a source are put in order of
length, the expected copies are summed up along that order, one random offset is added, and a document is emitted once
for each integer the sum crosses at it. So a document occurs the integer below or above its expected copies times, never
more than the cap, and since neighbours have like lengths the tokens of a source are those expected but for the length
of one document or so.

By default the total is the largest at which no source that has tokens is capped, so that their shares stand exactly as
the targets do to each other; with a given total, a source that can't reach its share at its cap gives all it may and
the others share the rest by their targets (water filling), as far as their own caps allow.

Defined results: a source without target or documents without a source are left out; a target source without tokens, or
of share 0, gets actual share 0; null and empty texts have no tokens and are never emitted; null or negative shares
count as 0 and null caps as 1; equal texts are documents of their own; an empty table gives an empty selection.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logothek.llm.encode import TOKENIZERS, counted_rows
from logothek.operators.order import ranked
from logothek.session import checkpointed, spread


def plan(tokens: dict[str, int], shares: dict[str, float], caps: dict[str, int], total: float | None = None) -> dict[str, float]:
    """Expected copies of a document by source.

    tokens: tokens of one copy of each source. total: tokens wanted in all; None takes the largest that needs no cap.
    """
    live = {s for s in shares if shares[s] > 0 and tokens.get(s, 0) > 0 and caps[s] > 0}
    if not live:
        return {}
    whole = math.fsum(shares[s] for s in live)
    if total is None:
        total = min(tokens[s] * caps[s] * whole / shares[s] for s in live)
    given: dict[str, float] = {}
    rest, open_ = float(total), set(live)
    while open_:
        weight = math.fsum(shares[s] for s in open_)
        full = {s for s in open_ if rest * shares[s] / weight > tokens[s] * caps[s] * (1 + 1e-12)}
        if not full:
            given |= {s: rest * shares[s] / weight for s in open_}
            break
        for s in full:
            given[s] = float(tokens[s] * caps[s])
        rest -= math.fsum(given[s] for s in full)
        open_ -= full
    return {s: min(float(caps[s]), given[s] / tokens[s]) for s in given}


def sizes(documents: DataFrame, targets: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents of target sources that have tokens; checkpointed, as counting is the dear part."""
    names = [(r.source,) for r in target_list(targets)]
    wanted = F.broadcast(targets.sparkSession.createDataFrame(names, "source string"))
    own = documents.where(F.length("text") > 0).select("doc_id", "source", "text").join(wanted, "source", "left_semi").select("doc_id", "source", "text")
    return checkpointed(counted_rows(spread(own), "text", name, folder))


def target_list(targets: DataFrame, limit: int = 10_000) -> list:
    """The targets on the driver; a mixture of more than ``limit`` sources is refused, never cut."""
    rows = targets.where("source IS NOT NULL").groupBy("source").agg(F.max(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats")).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} sources in the targets")
    return rows


def mixed(sized: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 0) -> DataFrame:
    """(doc_id, source, copy_no, n_tokens): one row for each copy of each document that is selected."""
    wanted = target_list(targets)
    have = {r.source: r.n for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    copies = plan(have, {r.source: max(0.0, r.target_share) for r in wanted}, {r.source: max(0, r.max_repeats) for r in wanted}, total)
    spark = sized.sparkSession
    table = F.broadcast(spark.createDataFrame([(s, float(e)) for s, e in sorted(copies.items())], "source string, expected double"))
    placed = ranked(sized.withColumn("_h", F.xxhash64("doc_id", F.lit(seed))), "source", ["n_tokens", "_h", "doc_id"]).join(table, "source")
    # the one random offset of the whole selection, in [0, 1)
    offset = F.pmod(F.xxhash64(F.lit("offset"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    after = F.floor((F.col("rank") + 1) * F.col("expected") + offset)
    before = F.floor(F.col("rank") * F.col("expected") + offset)
    return placed.select("doc_id", "source", "n_tokens", (after - before).cast("int").alias("k")).where("k > 0").select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("copy_no"), "n_tokens")


def shares(sized: DataFrame, selection: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: share wanted, tokens at hand, documents, rows and tokens selected, most copies of a document, actual share."""
    at_hand = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens_at_hand"))
    got = selection.groupBy("source").agg(F.countDistinct("doc_id").alias("n_documents"), F.count("*").alias("n_rows"), F.sum("n_tokens").alias("tokens_selected"), F.max("copy_no").alias("most_copies"))
    whole = F.broadcast(selection.agg(F.sum("n_tokens").alias("_whole")))
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return (
        targets.select("source", "target_share", "max_repeats").join(at_hand, "source", "left").join(got, "source", "left").crossJoin(whole)
        .select("source", "target_share", "max_repeats", *map(none, ("tokens_at_hand", "n_documents", "n_rows", "tokens_selected", "most_copies")), (F.coalesce("tokens_selected", F.lit(0)) / F.greatest("_whole", F.lit(1))).alias("actual_share"))
    )
