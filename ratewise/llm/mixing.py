"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact word length within each source. A source whose target is r whole copies and a rest
takes every document r times; the rest is met by documents chosen by their lengths alone: each length first gives its
proportional share, at every size of the budget, then a bounded-knapsack dynamic program over the lengths' remaining
counts fills the last words of the budget as exactly as any choice can. Which documents of a length are chosen follows
a seeded order.

Only histograms (distinct lengths of a source, at most the square root of twice its words) meet in a task. Documents
are ranked within (source, length) in buckets, so a hot group is cut up.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratewise.llm import common, ranks

#: No document is taken more often than this.
MOST_COPIES = 3
#: Shares are handed out until no more words than this are left for the dynamic program, or no document is that short.
WINDOW = 1 << 16


def water_targets(sizes: DataFrame, copies: int = MOST_COPIES, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Targets from (source, source_size): all words shared by weight, none above copies times its source, the excess reshared.

    Weights repeat in cycle over the sources by code point, null last. The level at which capped sources free as much as
    the others take is found over the sources in order of cap per weight; a source's target is min(cap, level * weight).
    """
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    order = Window.orderBy(F.col("source").isNull(), "source")  # one row for each source
    x = sizes.withColumn("weight", F.element_at(weights, ((F.row_number().over(order) - 1) % len(cycle) + 1).cast("int")))
    x = x.withColumn("cap", F.col("source_size") * float(copies)).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    x = x.withColumn("before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    x = x.withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    x = x.withColumn("level", (F.sum("source_size").over(everything) - F.col("before")) / F.col("open"))
    x = x.withColumn("water", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
    return x.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("water"), F.lit(0.0)) * F.col("weight")).alias("target"))


def _filled(lengths: np.ndarray, free: np.ndarray, left: int) -> tuple[np.ndarray, int]:
    """(documents of each length, how far their words end from left): a bounded knapsack, as near to left as any choice.

    Binary splitting of the counts; reachable sums are the bits of one integer, up to left at first. Where left itself is
    out of reach, a second pass looks above it, no farther than what the first one missed.
    """
    limit, order = left, np.argsort(lengths, kind="stable")
    while True:
        mask, reach, steps = (1 << (limit + 1)) - 1, 1, []
        for i in order:
            n, piece = int(min(free[i], limit // max(1, int(lengths[i])))), 1
            while n > 0 and not reach >> left & 1:  # once left is reached, longer documents are not needed
                piece = min(piece, n)
                steps.append((i, piece, reach))
                reach |= (reach << (piece * int(lengths[i]))) & mask
                n, piece = n - piece, piece * 2
        best = (reach & ((1 << (left + 1)) - 1)).bit_length() - 1
        if limit > left or left - best <= 1:
            break
        limit = 2 * left - best - 1
    above = reach >> (left + 1)
    if above:
        best = left + (above & -above).bit_length()
    miss, extra = abs(left - best), np.zeros(len(free), np.int64)
    for i, piece, earlier in reversed(steps):
        if not earlier >> best & 1:
            best -= piece * int(lengths[i])
            extra[i] += piece
    return extra, miss


#: Documents of a length that are given back at most where the shares leave the budget out of reach.
GIVEN_BACK = 8


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int, window: int = WINDOW) -> np.ndarray:
    """How many documents of each length to choose so that their words come as near to budget as found.

    Every length gives its proportional share in whole documents. Where more than window words are left by the parts of
    documents, lengths give one more in order of their largest remainders, and shares are handed out again, so that a
    large budget takes each length in proportion as a small one does. More than window words are left only where every
    document that is still free is longer than that. A bounded knapsack over the counts that remain fills the rest. Where
    it misses, some documents of each length, the shortest first, are given back while no more than window words are left,
    and the knapsack runs again; the nearer result counts.
    """
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return np.zeros(len(counts), np.int64)
    if budget >= total:
        return counts.copy()
    chosen, left = np.zeros(len(counts), np.int64), budget
    while True:
        free, before = counts - chosen, left
        shares = free * (left / int((lengths * free).sum()))
        give = np.minimum(shares.astype(np.int64), free)
        chosen += give
        left -= int((lengths * give).sum())
        for i in np.argsort(give - shares, kind="stable"):
            if left <= window:
                break
            if chosen[i] < counts[i] and lengths[i] <= left:
                chosen[i] += 1
                left -= int(lengths[i])
        if left <= window or left == before:
            break
    if left < 0:
        return chosen
    extra, miss = _filled(lengths, counts - chosen, left)
    if miss:
        fewer, more = chosen.copy(), left
        for _ in range(GIVEN_BACK):
            for i in np.argsort(lengths, kind="stable"):
                if more <= window and fewer[i]:
                    fewer[i] -= 1
                    more += int(lengths[i])
        again, nearer = _filled(lengths, counts - fewer, more)
        if nearer < miss:
            return fewer + again
    return chosen + extra


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("size").reset_index(drop=True)
    target, size = float(pdf["target"].iloc[0]), int(pdf["source_size"].iloc[0])
    whole = min(MOST_COPIES, int(target // size)) if size else 0
    chosen = fit_counts(pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), round(target - whole * size) if whole < MOST_COPIES else 0)
    return pd.DataFrame({"g": pdf["g"], "size": pdf["size"], "whole": whole, "chosen": chosen})


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7) -> DataFrame:
    """What a mix takes of every document: doc_id, size, source, source_size, target, taken, copies, h (the text's hash).

    size: words of the text (null text: 0). taken: words taken, size times copies, copies 0 to 3. Null sources are a
    source of their own. Documents without words are never chosen beyond the whole copies, and take 0. Rows that repeat
    an id count as documents of their own. An empty table gives an empty result. Reruns give the same rows.
    """
    sized = common.staged(
        docs.select(docs[id_col].alias("doc_id"), docs[source_col].cast("string").alias("source"), F.coalesce(F.regexp_count(docs[text_col], F.lit(common.WORD)), F.lit(0)).cast("bigint").alias("size"), F.xxhash64(docs[text_col]).alias("h"))
        .withColumn("g", common.group_key(F.col("source"))),
        "mix-sizes",
    )
    histogram = common.staged(sized.groupBy("g", "source", "size").agg(F.count("*").alias("n")), "mix-histogram")
    sources = histogram.groupBy("g", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = common.staged(water_targets(sources).withColumn("g", common.group_key(F.col("source"))), "mix-targets")
    lengths = histogram.filter("size > 0").select("g", "size", "n").join(targets.select("g", "source_size", "target"), "g")
    plan = common.staged(lengths.groupBy("g").applyInPandas(_plan, "g string, size long, whole int, chosen long"), "mix-plan")
    rows = sized.join(plan, ["g", "size"], "left").fillna({"whole": 0, "chosen": 0})
    rows = rows.withColumn("gl", F.concat_ws(":", "size", "g")).withColumn("u", common.seeded_unit(seed, F.col("doc_id"), F.col("h")))
    certain = rows.filter("chosen = 0").withColumn("extra", F.lit(0))
    ranked = ranks.with_rank(rows.filter("chosen > 0"), "gl", "u", ["doc_id", "h"], "rank", "n").withColumn("extra", (F.col("rank") < F.col("chosen")).cast("int"))
    every = certain.unionByName(ranked.select(certain.columns)).join(targets.select("g", "source_size", "target"), "g")
    copies = F.col("whole") + F.col("extra")
    return every.select("doc_id", "size", "source", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), "h")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7) -> DataFrame:
    """docs as the mix takes them: each row as often as its copies, with docs' own columns.

    Documents without words have nothing to take and stay out. Rows that share id, text and source get their copies in the
    order of their other columns: of those, the mix takes some once more than the rest.
    """
    key = [F.xxhash64(docs[text_col]).alias("_h"), common.group_key(docs[source_col].cast("string")).alias("_g"), docs[id_col].alias("_id")]
    plan = mix(docs, id_col, text_col, source_col, seed).filter("size > 0").groupBy(F.col("h").alias("_h"), common.group_key(F.col("source")).alias("_g"), F.col("doc_id").alias("_id")).agg(
        F.min("copies").alias("_least"), F.max("copies").alias("_most"), F.count("*").alias("_n"), F.sum("copies").alias("_all")).filter("_most > 0")
    plan = common.staged(plan, "mix-copies")
    rows = docs.select(F.struct("*").alias("row"), *key, F.coalesce(F.regexp_count(docs[text_col], F.lit(common.WORD)), F.lit(0)).alias("_size")).filter("_size > 0")
    left, right = rows.alias("l"), plan.alias("r")
    on = (F.col("l._h") == F.col("r._h")) & (F.col("l._g") == F.col("r._g")) & F.col("l._id").eqNullSafe(F.col("r._id"))
    found = left.join(right, on).select("row", "l._h", "l._g", "l._id", "_least", "_most", "_n", "_all")
    even = found.filter("_least = _most").select("row", F.col("_most").alias("_copies"))
    within = Window.partitionBy("_h", "_g", "_id").orderBy(F.xxhash64("row"))  # only rows alike that the mix tells apart: one text of a length and source at most
    odd = found.filter("_least <> _most").withColumn("_k", F.row_number().over(within))
    odd = odd.select("row", (F.col("_least") + (F.col("_k") <= F.col("_all") - F.col("_least") * F.col("_n")).cast("int")).alias("_copies"))
    taken = even.unionByName(odd.select("row", F.col("_copies").cast(even.schema["_copies"].dataType).alias("_copies"))).filter("_copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("row.*")
