"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seed within each source and get the fractional rank (rank + 1/2) / rows of the source. In order
of fractional rank every stretch of rows holds each source in proportion; cutting that order into equal counts gives
shards that all match the mixture, with row counts at most one apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewise.llm import common, ranks


def interleaved_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 11) -> DataFrame:
    """A shard and a place in it for every row: doc_id, source, size, text_crc32, law, shard, slot, grown_shard.

    size: bytes of the text plus 1 (null text: 1). law is 'rows': counts at most one apart. slot counts from 0 within a
    shard, in the order of fractional rank. grown_shard is null, as the law is not 'key'. Null sources are a source of
    their own; repeated rows are rows of their own. With fewer rows than shards some shards are empty.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = common.staged(
        docs.select(docs[id_col].alias("doc_id"), docs[source_col].cast("string").alias("source"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
        .withColumn("g", common.group_key(F.col("source")))
        .withColumn("u", common.seeded_unit(seed, F.col("doc_id"), F.col("text_crc32"), F.col("size"))),
        "shard-rows",
    )
    ranked = common.staged(ranks.with_rank(rows, "g", "u", ["doc_id", "text_crc32", "size"], "rank", "n"), "shard-ranks")
    ordered = ranked.withColumn("fraction", (F.col("rank") + 0.5) / F.col("n")).withColumn("everything", F.lit("")).drop("n", "rank")
    placed = ranks.with_rank(ordered, "everything", "fraction", ["u", "g", "doc_id", "text_crc32", "size"], "place", "total")
    # the first total % shards shards have one row more
    few, more = F.floor(F.col("total") / shards), F.col("total") % shards
    cut = more * (few + 1)
    shard = F.when(F.col("place") < cut, F.floor(F.col("place") / (few + 1))).otherwise(more + F.floor((F.col("place") - cut) / F.greatest(few, F.lit(1))))
    start = F.col("shard") * few + F.least(F.col("shard"), more)
    return placed.withColumn("shard", shard).select("doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("place") - start).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
