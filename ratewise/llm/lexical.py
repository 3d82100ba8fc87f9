"""Ranked lexical search by dense blocked BLAS products.

The items' distinct terms are a compact vocabulary; one pass over the corpus keeps, of every document, its number of
terms and the counts of the vocabulary's terms. A task then multiplies tiles: items by vocabulary (the terms' weights)
times vocabulary by documents (their impacts), in float64. Weights and impacts are whole numbers, and a vocabulary tile
is cut so that the sums of its products stay below 2**53, so each product is exact in whatever order it is summed; tiles
are added as 64-bit integers. Each task keeps the best of each item, ties by document; the tasks' best meet in two steps.

Items come in blocks of about BLOCK_TERMS distinct (item, term) pairs, so what is broadcast and collected does not grow
with the number of items; each block reads the documents once.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratewise.llm import common

#: A term, for Java and DuckDB.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: (Item, term) pairs of a block of items, about; an item with more is a block of its own size.
BLOCK_TERMS = 32_768
#: Tiles: items, vocabulary columns and documents.
ITEM_TILE, TERM_TILE, DOC_TILE = 128, 4096, 512
#: Sums of products of a vocabulary tile stay below this.
EXACT = 1 << 53
#: Largest impact: 1000000000 * tf div (1000 * tf + 8 * m) is below it for every m >= 0.
MOST_IMPACT = 1_000_000

#: A byte's place in a term: A-Z as a-z, other ASCII but digits and letters as a blank, the rest as it is.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """A text's terms in order, A-Z lower-cased; none of a null text."""
    return text.translate(_BYTES).split() if text else []


def _counted(docs: DataFrame, id_col: str, text_col: str, vocabulary: list[bytes]) -> DataFrame:
    """doc_id, n (all terms), at and tf (places in the vocabulary of the terms found, and their counts)."""
    places = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def count(batches):
        place = places.value
        for batch in batches:
            n, at, tf = [], [], []
            for text in batch.column(1).cast(pa.binary()):
                words = terms(text.as_py())
                found = [(place[t], c) for t, c in Counter(words).items() if t in place]
                n.append(len(words))
                at.append([i for i, _ in found])
                tf.append([c for _, c in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int64()))], ["doc_id", "n", "at", "tf"])

    return common.in_arrow(docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text")), count, "doc_id long, n long, at array<int>, tf array<long>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _tiles(places: list[list[int]], weights: np.ndarray) -> list[tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """Item tiles: (item numbers, [(vocabulary places, weights as items x places)]) with exact products in each."""
    out = []
    for start in range(0, len(places), ITEM_TILE):
        items = np.arange(start, min(start + ITEM_TILE, len(places)))
        columns, cut, cuts, room = sorted({p for i in items for p in places[i]}), [], [], EXACT - 1
        for p in columns:
            if cut and (len(cut) == TERM_TILE or room < int(weights[p]) * MOST_IMPACT):
                cuts, cut, room = [*cuts, cut], [], EXACT - 1
            cut.append(p)
            room -= int(weights[p]) * MOST_IMPACT
        cuts = [*cuts, cut] if cut else cuts
        parts = []
        for cut in cuts:
            at = {p: k for k, p in enumerate(cut)}
            w = np.zeros((len(items), len(cut)))
            for row, i in enumerate(items):
                for p in places[i]:
                    if p in at:
                        w[row, at[p]] = weights[p]
            parts.append((np.array(cut, np.int64), w))
        out.append((items, parts))
    return out


class _Best:
    """The best (score, doc) of each item so far: higher scores first, then smaller documents; a null document is last."""

    def __init__(self, items: int, k: int):
        self.k, self.found = k, [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))] * items
        self.least = np.ones(items, np.int64)  # a score below it cannot be among the best

    def add(self, items: np.ndarray, scores: np.ndarray, docs: np.ndarray, null: np.ndarray) -> None:
        """scores: items x documents."""
        for row in np.flatnonzero((scores >= self.least[items, None]).any(axis=1)):
            i = items[row]
            hit = np.flatnonzero(scores[row] >= self.least[i])
            s, d, z = (np.concatenate([a, b[hit]]) for a, b in zip(self.found[i], (scores[row], docs, null), strict=True))
            order = np.lexsort((d, z, -s))[: self.k]
            self.found[i] = (s[order], d[order], z[order])
            if len(order) == self.k:
                self.least[i] = s[order[-1]]  # an equal score still counts: its document may be smaller


def _searched(counted: DataFrame, plan: dict, k: int) -> DataFrame:
    """Each task's best documents: item (number), doc_id, score."""
    shared = counted.sparkSession.sparkContext.broadcast(plan)

    def search(batches):
        plan = shared.value
        best = _Best(plan["items"], k)
        for batch in batches:
            for start in range(0, batch.num_rows, DOC_TILE):
                part = batch.slice(start, DOC_TILE)
                n = np.asarray(part.column(1), np.int64)
                null = np.asarray(part.column(0).is_null())
                docs = np.asarray(part.column(0).fill_null(0), np.int64)
                lists, counts = part.column(2), part.column(3)
                rows = np.repeat(np.arange(len(n)), np.asarray(lists.value_lengths(), np.int64))
                at, tf = np.asarray(lists.flatten(), np.int64), np.asarray(counts.flatten(), np.int64)
                m = 10 + (90 * n * plan["docs"]) // plan["terms"]
                impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[rows])
                dense = np.zeros((plan["vocabulary"], len(n)))
                dense[at, rows] = impact
                for items, parts in plan["tiles"]:
                    scores = np.zeros((len(items), len(n)), np.int64)
                    for places, w in parts:
                        scores += (w @ dense[places]).astype(np.int64)
                    best.add(items, scores, docs, null)
        for i, (s, d, z) in enumerate(best.found):
            if len(s):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), i)), pa.array(d, mask=z), pa.array(s)], ["item", "doc_id", "score"])

    return common.in_arrow(counted, search, "item long, doc_id long, score long")


def _first(df: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: of each item the k documents of highest score above 0, equal scores by ascending document.

    Rows that repeat an item's id are items of their own, rows that repeat a document's id documents of their own; a null
    document id comes last among equal scores. Null and empty texts hold no term: such an item has no row. Without any
    document the result is empty. Other columns are not read.
    """
    spark = docs.sparkSession
    queries = items.select(items[item_col].cast("bigint").alias("item_id"), F.array_distinct(F.regexp_extract_all(common.ascii_lower(items[query_col]), F.lit(TERM), F.lit(0))).alias("terms")).filter(F.size("terms") > 0)
    queries = common.staged(queries, "lexical-items")
    pairs = queries.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    blocks = max(1, -(-pairs // block_terms))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)))
    out, empty = None, spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in range(blocks):
        rows = queries.filter(F.col("block") == block).select("item_id", "terms").collect()  # about block_terms terms
        if not rows:
            continue
        vocabulary = sorted({t.encode() for r in rows for t in r["terms"]})
        place = {t: i for i, t in enumerate(vocabulary)}
        counted = common.staged(_counted(docs, id_col, text_col, vocabulary), "lexical-counts")
        whole = counted.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        if not whole["docs"]:
            return empty
        df = np.zeros(len(vocabulary), np.int64)
        for r in counted.select(F.explode("at").alias("at")).groupBy("at").count().collect():  # a row for each term of the block
            df[r[0]] = r[1]
        weights = np.array([weight(whole["docs"], int(x)) for x in df], np.int64)
        plan = {"items": len(rows), "vocabulary": len(vocabulary), "docs": whole["docs"], "terms": whole["terms"], "tiles": _tiles([[place[t.encode()] for t in r["terms"]] for r in rows], weights)}
        mine = _searched(counted.filter(F.size("at") > 0), plan, k).withColumn("some", F.pmod(F.spark_partition_id(), F.lit(256)))
        best = _first(_first(mine, ["item", "some"], k).drop("rank"), ["item"], k)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], "item long, item_id long")  # the items of the block
        found = common.staged(best.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int"), "doc_id", "score"), "lexical-best")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else empty
