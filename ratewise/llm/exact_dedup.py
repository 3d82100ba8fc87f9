"""Exact deduplication by an extendible-hash index in the shared folder.

1. Every row's digest goes to a small table of the shared folder.
2. The directory: digests fall by their leading 16 bits into cells; a bucket with more than `bucket_keys` distinct digests is
   split on its next bit, which doubles the directory whenever the bucket is as deep as the directory. Directory slots are
   bounded by 2**MAX_DEPTH; a bucket of that depth holds more digests instead, which only makes its owner's stream longer.
3. Texts, first reduced within each input partition (one row for each distinct text), go to owner tasks. An owner has a
   range of buckets, several on average, so that a full bucket is split rather than its owner overloaded. It reads them in
   order of digest as a stream, chains the texts of equal digest and compares their bytes.
4. The resolved index is written to the shared folder and joined back to the digests.

Only step 3 moves texts, once. A text that a third of all rows have reaches its owner as one row for each input
partition; in the join of step 4 both sides are small rows and Spark splits the hot key.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewise.llm import common

#: The directory never has more slots than 2**MAX_DEPTH.
MAX_DEPTH = 16
#: Distinct digests of a bucket before it is split, at most.
BUCKET_KEYS = 50_000
#: Buckets of an owner, about: a bucket also is split where owners would have fewer.
BUCKETS_OF_OWNER = 8
#: Bytes of texts that an owner reads, about.
OWNER_BYTES = 128 << 20
#: Bytes of texts that a task holds while it reduces its own partition.
HELD_BYTES = 16 << 20


def normalised(text):
    """Every run of ASCII white space becomes one space; a null text is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), common.SPACE, " ")


def directory(cells: dict[int, int], bucket_keys: int, max_depth: int = MAX_DEPTH) -> tuple[int, list[tuple[int, int]]]:
    """(global depth, bucket of each slot as (prefix, local depth)) from the distinct keys in each of 2**max_depth cells."""
    counts = [0] * (1 << max_depth)
    for cell, n in cells.items():
        counts[cell] = n
    tree = [counts]
    while len(tree[-1]) > 1:
        below = tree[-1]
        tree.append([below[i] + below[i + 1] for i in range(0, len(below), 2)])
    tree.reverse()  # tree[d][prefix]: keys below a prefix of d bits
    depth, slots = 0, [(0, 0)]
    while over := {b for b in slots if tree[b[1]][b[0]] > bucket_keys and b[1] < max_depth}:
        if any(local == depth for _, local in over):
            depth, slots = depth + 1, [b for b in slots for _ in range(2)]
        slots = [(p * 2 + (i >> (depth - d - 1) & 1), d + 1) if (p, d) in over else (p, d) for i, (p, d) in enumerate(slots)]
    return depth, slots


def _reduced(batches, held_bytes: int):
    """Of a partition's rows (doc_id, norm, digest): one row for each distinct text among those held at a time."""
    held: dict[str, list[list]] = {}
    size = 0

    def flush():
        every = [(d, *e) for d, chain in held.items() for e in chain]
        held.clear()
        for i in range(0, len(every), 1000):
            rows = every[i : i + 1000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64())],
                names=["digest", "norm", "first_id", "rows"],
            )

    for batch in batches:
        for doc_id, norm, digest in zip(*(batch.column(i) for i in range(3)), strict=True):
            doc_id, norm, digest = doc_id.as_py(), norm.as_py(), digest.as_py()
            chain = held.setdefault(digest, [])
            for entry in chain:
                if entry[0] == norm:
                    entry[1] = doc_id if entry[1] is None or doc_id is not None and doc_id < entry[1] else entry[1]
                    entry[2] += 1
                    break
            else:
                chain.append([norm, doc_id, 1])
                size += len(norm) + 200
            if size > held_bytes:
                yield from flush()
                size = 0
    yield from flush()


def _resolved(batches):
    """Rows in order of digest: one row for each distinct text of a digest; its text only if the digest has several."""
    current, chain = None, []
    out: list[tuple] = []

    def close():
        for place, (norm, first, rows) in enumerate(chain):
            out.append((current, place, norm if len(chain) > 1 else None, first, rows))

    def batch_of():
        done, out[:] = out[:], []
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)],
            names=["digest", "place", "chained", "keep_id", "group_size"],
        )

    for batch in batches:
        for row in zip(*(batch.column(n) for n in ("digest", "norm", "first_id", "rows")), strict=True):
            digest, norm, first, rows = (x.as_py() for x in row)
            if digest != current:
                close()
                current, chain = digest, []
            for entry in chain:
                if entry[0] == norm:
                    entry[1] = first if entry[1] is None or first is not None and first < entry[1] else entry[1]
                    entry[2] += rows
                    break
            else:
                chain.append([norm, first, rows])
        if len(out) > 5000:
            yield batch_of()
    close()
    if out:
        yield batch_of()


def owners_of(slots: list[tuple[int, int]], cells: dict[int, int], depth: int, owners: int, max_depth: int = MAX_DEPTH) -> dict[tuple[int, int], int]:
    """The owner of each bucket: ranges of buckets in order of their prefixes, cut where the digests so far pass an even share."""
    width = 1 << (max_depth - depth)
    held = dict.fromkeys(slots, 0)
    for cell, n in cells.items():
        held[slots[cell // width]] += n
    total, before, out = max(1, sum(held.values())), 0, {}
    for bucket, n in held.items():
        out[bucket] = min(owners - 1, (2 * before + n) * owners // (2 * total))
        before += n
    return out


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_keys: int | None = None, digest_digits: int = 64) -> DataFrame:
    """Groups of equal normalised texts: one row for each input row.

    Columns: doc_id, keep_id (smallest id of the group; null ids count as largest), group_size long, kept boolean,
    text_sha256. A null text is an empty text. Rows that repeat the kept row's id in one group are all marked kept;
    `deduplicated` keeps one of them. An empty table gives an empty result. Other columns are ignored. bucket_keys: digests
    of a bucket before it is split; without it, BUCKET_KEYS or as few as give an owner its number of buckets.
    digest_digits shortens the digest, so that tests meet texts that share one.
    """
    spark = docs.sparkSession
    norm = normalised(docs[text_col])
    sha = F.sha2(norm.cast("binary"), 256)
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), norm.alias("norm"), sha.alias("text_sha256"))
    rows = rows.withColumn("digest", F.substring("text_sha256", 1, digest_digits))
    cell = F.conv(F.rpad(F.substring("digest", 1, MAX_DEPTH // 4), MAX_DEPTH // 4, "0"), 16, 10).cast("int")
    digests = common.staged(rows.select("doc_id", "text_sha256", "digest", F.octet_length("norm").alias("bytes")), "dedup-digests")

    distinct = digests.groupBy("digest").agg(F.max("bytes").alias("bytes"))
    found_cells = distinct.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).collect()  # at most 2**MAX_DEPTH rows
    cells = {r["cell"]: r["n"] for r in found_cells}
    owners = min(1 << MAX_DEPTH, max(common.shuffle_partitions(spark), sum(r["bytes"] for r in found_cells) // OWNER_BYTES))
    if bucket_keys is None:
        bucket_keys = max(1, min(BUCKET_KEYS, sum(cells.values()) // (BUCKETS_OF_OWNER * owners)))
    depth, slots = directory(cells, bucket_keys)
    owner = owners_of(slots, cells, depth, owners)
    width = 1 << (MAX_DEPTH - depth)
    plan = spark.createDataFrame([(c, owner[slots[c // width]]) for c in range(1 << MAX_DEPTH)], "cell int, owner int")

    entries = common.in_arrow(rows.select("doc_id", "norm", "digest"), lambda it: _reduced(it, HELD_BYTES), "digest string, norm string, first_id long, rows long")
    owned = entries.withColumn("cell", cell).join(F.broadcast(plan), "cell")  # 2**MAX_DEPTH rows
    owned = owned.repartitionById(owners, F.col("owner")).sortWithinPartitions("digest").select("digest", "norm", "first_id", "rows")
    resolved = common.in_arrow(owned, _resolved, "digest string, place int, chained string, keep_id long, group_size long")
    index = common.staged(resolved, "dedup-index")

    single = index.filter("chained is null").select("digest", "keep_id", "group_size")
    found = digests.select("digest", "doc_id", "text_sha256").join(single, "digest")
    if not index.filter("chained is not null").isEmpty():
        chains = index.filter("chained is not null")
        found = found.unionByName(rows.join(chains, (rows["digest"] == chains["digest"]) & (F.col("norm") == F.col("chained"))).select(rows["digest"], "doc_id", "text_sha256", "keep_id", "group_size"))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with one row of each group of equal texts (the smallest id) and all its columns.

    Where the smallest id repeats within a group, one of its rows stays, whichever.
    """
    groups = exact_groups(docs, id_col, text_col)
    kept = groups.filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    sha = F.sha2(normalised(docs[text_col]).cast("binary"), 256)
    whole = docs.select(F.struct("*").alias("row"), docs[id_col].cast("bigint").alias("_id"), sha.alias("_sha"))  # docs' own columns may have any names
    rows = whole.alias("l").join(kept.alias("r"), F.col("l._id").eqNullSafe(F.col("r._id")) & (F.col("l._sha") == F.col("r._sha")), "left_semi")
    repeated = groups.filter("kept").groupBy("doc_id", "text_sha256").count().filter("count > 1")
    if not repeated.isEmpty():
        rows = rows.dropDuplicates(["_id", "_sha"])
    return rows.select("row.*")
