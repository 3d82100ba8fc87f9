"""Vector best-fit packing of tokenised documents into sequences.

Pieces of one length are alike, so packing needs only how many pieces each length has: at most `capacity` numbers,
however large the corpus. Bins with the same residual capacities (tokens, documents, attention cost) form a class of
known multiplicity. Lengths come longest first; a piece goes to the feasible class that the score prefers, and one step
places as many pieces as the class has bins. A class covers a range of sequence numbers, so the plan is a short list of
assignments: pieces of a length with ranks a..b go to sequences s..s+b-a at one offset. Tasks look their pieces up in it.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratewise.llm import common, tokens


@dataclass(frozen=True)
class Limits:
    """tokens: of a sequence. documents: pieces in a sequence. attention: sum of squared piece lengths. By default only tokens bind."""

    tokens: int = 4096
    documents: int = 4096
    attention: int = 4096 * 4096


def plan(counts: np.ndarray, limits: Limits = Limits(), score: str = "norm", weights: tuple[float, float, float] = (1.0, 0.05, 0.05)) -> np.ndarray:
    """Assignments (length, first rank, pieces, first sequence, offset) for counts[length] pieces of each length.

    score 'norm': the smallest weighted norm of what is left of the capacities after placing; 'dot': the largest weighted
    dot product of the piece's demand and the residual capacities. All capacities hold in every sequence.
    """
    capacity = np.array([limits.tokens, limits.documents, limits.attention], float)
    w = np.array(weights)
    residual, base, size = np.empty((1024, 3)), np.empty(1024, np.int64), np.empty(1024, np.int64)
    classes, sequences = 0, 0
    out: list[tuple[int, int, int, int, int]] = []

    def add(r, b, n):
        nonlocal residual, base, size, classes
        if classes == len(base):
            residual, base, size = (np.concatenate([x, np.empty_like(x)]) for x in (residual, base, size))
        residual[classes], base[classes], size[classes] = r, b, n
        classes += 1

    for length in range(len(counts) - 1, 0, -1):
        left, rank = int(counts[length]), 0
        demand = np.array([length, 1.0, float(length) * length])
        if left and (demand > capacity).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        while left:
            fits = np.flatnonzero((residual[:classes] >= demand).all(1))
            if len(fits):
                r = residual[fits]
                value = -((r * demand / capacity**2) @ w) if score == "dot" else (((r - demand) / capacity) ** 2) @ w
                c = int(fits[np.argmin(value)])
                n = min(left, int(size[c]))
                out.append((length, rank, n, int(base[c]), int(capacity[0] - residual[c, 0])))
                if n < size[c]:
                    add(residual[c].copy(), base[c] + n, size[c] - n)
                    size[c] = n
                residual[c] -= demand
                if residual[c, 0] <= 0 or residual[c, 1] <= 0:  # full: its place goes to the last class
                    classes -= 1
                    residual[c], base[c], size[c] = residual[classes], base[classes], size[classes]
            else:
                each = int((capacity // demand).min())
                n = max(1, left // each)
                each = min(each, left)
                for k in range(each):
                    out.append((length, rank + k * n, n, sequences, k * length))
                rest = capacity - each * demand
                if rest[0] > 0 and rest[1] > 0:
                    add(rest, sequences, n)
                sequences += n
                left, rank = left - n * each, rank + n * each
                continue
            left, rank = left - n, rank + n
    return np.array(out, np.int64).reshape(-1, 5)


def _pieces(batches, path: str, end_id: int, most: int):
    """Tokenise; a row for each piece, with this task's number, the piece's rank among the task's pieces of its length, and the columns after id and text."""
    task, seen = TaskContext.get().partitionId(), np.zeros(most + 1, np.int64)
    encoder = tokens.encoder(path, keeps_space=False)
    for batch in batches:
        rows: list[tuple] = []
        places: list[int] = []
        for place, (doc_id, ids) in enumerate(zip(batch.column(0), encoder.encode(batch.column(1)), strict=True)):
            ids = np.append(ids, np.uint32(end_id)).astype("<u4")
            for k, start in enumerate(range(0, len(ids), most)):
                piece = ids[start : start + most]
                rows.append((doc_id.as_py(), k, start, len(piece), zlib.crc32(piece.tobytes()), task, int(seen[len(piece)])))
                places.append(place)
                seen[len(piece)] += 1
        if rows:
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            kept = [batch.column(i).take(pa.array(places)) for i in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)), *kept], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth", *batch.schema.names[2:]])


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, limits: Limits = Limits(), score: str = "norm", keep: tuple[str, ...] = ()) -> DataFrame:
    """Pieces and where they lie: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and docs' columns keep.

    A document is its ids and end_id (null or empty text: end_id alone); only documents longer than limits.tokens are cut,
    into pieces of that length and a rest. Rows that repeat an id are packed each. An empty table gives an empty result.
    A kept column named as one of the piece's own is an error.
    """
    spark = docs.sparkSession
    clash = set(keep) & {"doc_id", "piece", "start", "length", "ids_crc32", "task", "nth", "rank", "before", "sequence_id", "offset"}
    if clash:
        raise ValueError(f"columns of a piece: {sorted(clash)}")
    kept = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long{kept}"
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"), *[docs[c] for c in keep])
    pieces = common.staged(common.in_arrow(rows, lambda it: _pieces(it, tokenizer_path, end_id, limits.tokens), schema), "pack-pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = common.staged(by_task.withColumn("before", before), "pack-offsets")
    counts = np.zeros(limits.tokens + 1, np.int64)
    for r in offsets.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most limits.tokens rows
        counts[r["length"]] = r["n"]
    assigned = plan(counts, limits, score)
    order = np.lexsort((assigned[:, 1], assigned[:, 0]))
    shared = spark.sparkContext.broadcast(assigned[order])  # a few rows for each length

    def placed(batches):
        a = shared.value
        keys = a[:, 0] << 48 | a[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, length << 48 | rank, "right") - 1
            sequence = a[at, 3] + rank - a[at, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(a[at, 4]), *(batch.column(n) for n in keep)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *keep])

    ranked = pieces.join(offsets.select("length", "task", "before"), ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"), *[f"`{c}`" for c in keep])
    return ranked.mapInArrow(placed, f"doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long{kept}")
