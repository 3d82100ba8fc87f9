"""Document fingerprints from content-defined chunks.

A text's UTF-8 bytes are cut where a gear hash of the bytes before has zero bits: from LEAST bytes on under a strict
mask, from NORMAL bytes on under a loose one, at MOST bytes anyway, so lengths gather around one size. Cuts follow the
content, so an insertion moves them along. A fingerprint is the set of its chunks' digests with their lengths; the
likeness of two is containment: the bytes of the chunks that they share over the bytes of the smaller one.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewise.llm import common, textbytes

#: Bytes of a chunk: at least, from where on the loose mask holds, at most.
LEAST, NORMAL, MOST = 16, 32, 128
#: Bits that are zero at a cut. A bit depends on as many bytes as its place says, so these look at the last 10 to 16 bytes, never beyond a chunk's start.
STRICT, LOOSE = 0b1111111 << 9, 0b111 << 13

_GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)
_LENGTH_BITS = 16


def gear_hashes(buf: np.ndarray) -> np.ndarray:
    """At every byte the low 16 bits of h = 2 * h + gear[byte], which the last 16 bytes decide."""
    h = _GEAR[buf]
    for by in (1, 2, 4, 8):
        h[by:] += h[:-by].copy() << np.uint32(by)
    return h & np.uint32(0xFFFF)


def chunks(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text's number) of every chunk of the texts that lie between offsets."""
    h = gear_hashes(buf)
    strict = (np.flatnonzero((h & np.uint32(STRICT)) == 0) + 1).tolist()
    loose = (np.flatnonzero((h & np.uint32(LOOSE)) == 0) + 1).tolist()
    starts, ends, texts = [], [], []
    for k in range(len(offsets) - 1):
        at, stop = int(offsets[k]), int(offsets[k + 1])
        while at < stop:
            normal = at + NORMAL
            i = bisect_left(strict, at + LEAST)
            if i < len(strict) and strict[i] < normal:
                end = strict[i]
            else:
                j = bisect_left(loose, normal)
                end = min(loose[j] if j < len(loose) else stop, at + MOST)
            end = min(end, stop)
            starts.append(at)
            ends.append(end)
            texts.append(k)
            at = end
    return np.array(starts, np.int64), np.array(ends, np.int64), np.array(texts, np.int64)


def chunk_sets(texts: list[bytes]) -> list[np.ndarray]:
    """For each text its sorted distinct chunks, each a number: 48 bits of digest and 16 bits of length."""
    out = []
    for a, b in _portions([len(t) for t in texts]):
        buf = np.frombuffer(b"".join(texts[a:b]), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts[a:b]])])
        starts, ends, of = chunks(buf, offsets)
        codes = np.empty(0, np.uint64)
        if len(starts):
            codes = (textbytes.hashes(buf, starts, ends) >> np.uint64(_LENGTH_BITS)) << np.uint64(_LENGTH_BITS) | (ends - starts).astype(np.uint64)
        cut = np.searchsorted(of, np.arange(b - a + 1))
        out += [np.unique(codes[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)]
    return out


def _portions(sizes: list[int], most: int = 1 << 20) -> list[tuple[int, int]]:
    """Ranges of texts with about most bytes each, or one longer text."""
    cuts, start, held = [], 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            cuts.append((start, i))
            start, held = i, 0
        held += n
    return [*cuts, (start, len(sizes))] if sizes else []


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Bytes of shared chunks over the smaller text's bytes, each chunk once; 1 for two empty texts, 0 where one is empty."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    bytes_of = lambda x: int((x & np.uint64((1 << _LENGTH_BITS) - 1)).sum())
    return bytes_of(np.intersect1d(a, b, assume_unique=True)) / min(bytes_of(a), bytes_of(b))


def written(chunk_set: np.ndarray) -> str:
    return base64.b64encode(chunk_set.astype("<u8").tobytes()).decode()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u8").astype(np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, fingerprint of every row; a null text is empty. Rows stay where they are."""

    def task(batches):
        for batch in batches:
            texts = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
            prints = [written(s) for s in chunk_sets(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(prints, pa.string())], ["doc_id", "n_chars", "fingerprint"])

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), F.coalesce(F.length(docs[text_col]), F.lit(0)).cast("bigint").alias("n_chars"))
    return common.in_arrow(rows, task, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_chars long, fingerprint string")


#: Bytes of text of a range of documents, about, and ranges at most.
RANGE_BYTES, MOST_RANGES = 1 << 24, 100_000


def _last_at_least(bounds: str, value: str) -> Column:
    """The place of the last of descending bounds that is not below value; the last of all for a null. Binary search, a step for each bit of their number."""
    return F.expr(f"aggregate(sequence(0, 17), 0, (p, k) -> p + if(p + shiftleft(1, 17 - k) < size({bounds}) and coalesce(get({bounds}, p + shiftleft(1, 17 - k)) >= {value}, true), shiftleft(1, 17 - k), 0))")


def _neighbourhoods(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text) with range, guest: ranges of descending doc_id, each followed by the next range's first document as a guest.

    Bounds are ids of the table, drawn by their hash, so the document of each bound is the first of its range.
    """
    spark = docs.sparkSession
    whole = docs.agg(F.max("doc_id").alias("top"), F.count("doc_id").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    ranges = max(common.shuffle_partitions(spark), min(MOST_RANGES, (whole["bytes"] or 0) // RANGE_BYTES + 1))
    every = max(1, (whole["n"] or 0) // (ranges * 8))
    drawn = docs.filter((F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    ids = sorted((r[0] for r in drawn.collect()), reverse=True)  # about 8 for each range
    bounds = sorted({whole["top"], *ids[:: max(1, len(ids) // ranges)]} - {None}, reverse=True)
    cuts = spark.createDataFrame([(bounds,)], "bounds array<long>")
    rows = docs.crossJoin(F.broadcast(cuts)).withColumn("range", _last_at_least("bounds", "doc_id"))  # one row of bounds
    first = F.coalesce(F.get("bounds", F.col("range")) == F.col("doc_id"), F.lit(not bounds))
    before = F.pmod(F.col("range") - 1, F.lit(max(1, len(bounds))))
    places = F.array_compact(F.array(F.struct(F.col("range"), F.lit(0).alias("guest")), F.when(first, F.struct(before.alias("range"), F.lit(1).alias("guest")))))
    return rows.select("doc_id", "text", F.inline(places)).repartition(ranges, "range").sortWithinPartitions("range", "guest", F.desc_nulls_last("doc_id"), F.xxhash64("text"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document beside its edited text: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last half of the code points (rounded down) replaced by the first as many of the next
    document's, in descending order of the id; the last is followed by the first. A null text is empty; of two empty
    texts the likeness is 1, of an empty and another 0. Null ids come last, rows of one id in an order of their texts. A
    single document follows itself. Other columns are not read. Texts are shuffled once, into ranges of ids.
    """

    def task(batches):
        held = None  # (range, id, text, chunk set) of the row before
        for batch in batches:
            ids, ranges, guests = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            texts = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
            for a, b in _portions([len(t) for t in texts]):
                mine = chunk_sets(texts[a:b])
                rows, changed = [], []
                for k in range(a, b):
                    if held and held[0] == ranges[k]:
                        text = held[2].decode()
                        half = len(text) // 2
                        changed.append((text[: len(text) - half] + texts[k].decode()[:half]).encode())
                        rows.append((held[1], len(text), held[3], mine[k - a]))
                    held = None if guests[k] else (ranges[k], ids[k], texts[k], mine[k - a])
                if not rows:
                    continue
                after = chunk_sets(changed)
                yield pa.RecordBatch.from_arrays([
                    pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in changed]), pa.array([written(r[2]) for r in rows]), pa.array([written(s) for s in after]),
                    pa.array([likeness(r[2], s) for r, s in zip(rows, after, strict=True)], pa.float64()), pa.array([likeness(r[2], r[3]) for r in rows], pa.float64())],
                    ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    rows = _neighbourhoods(docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text")))
    return common.in_arrow(rows.select("doc_id", "text", "range", "guest"), task, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
