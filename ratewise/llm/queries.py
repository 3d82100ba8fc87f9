"""The queries op1 to op13 over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers

from ratewise.llm import content_chunks, exact_dedup, jaccard, langid, lexical, licenses, link_trust, mixing, packing, rp_forest, sharding, spelling, token_frames
from ratewise.llm.common import table


def op1_link_trust(spark, sf_dir):
    return link_trust.judge_urls(table(spark, sf_dir, "pages"))


def op2_budget_mix(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_set_relations(spark, sf_dir):
    return jaccard.similar_groups(table(spark, sf_dir, "documents")).drop("n_links")


def op4_rp_forest(spark, sf_dir):
    return rp_forest.neighbours(table(spark, sf_dir, "embeddings"))


def op5_token_frames(spark, sf_dir, tokenizer=None):
    return token_frames.encode_corpus(table(spark, sf_dir, "documents"), tokenizer or str(public_tokenizers.path("byte_bpe_50k.json")))


def op6_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op7_string_kernel(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_interleaved_shards(spark, sf_dir):
    return sharding.interleaved_shards(table(spark, sf_dir, "documents")).drop("source")


def op9_vector_best_fit(spark, sf_dir, tokenizer=None):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer or str(public_tokenizers.path("word_bpe_49k.json")))


def op10_license_rules(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents")).drop("hits")


def op11_trie_frontier(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_blocked_blas(spark, sf_dir):
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_content_chunks(spark, sf_dir):
    return content_chunks.edited_fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_link_trust, op2_budget_mix, op3_set_relations, op4_rp_forest, op5_token_frames, op6_exact_dedup, op7_string_kernel, op8_interleaved_shards, op9_vector_best_fit, op10_license_rules, op11_trie_frontier, op12_blocked_blas, op13_content_chunks)}

SQL = {
    "op6_exact_dedup": r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
""",
    "op12_blocked_blas": r"""
WITH lowered AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
 d AS (SELECT doc_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM lowered),
 tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL), n AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY 1),
 whole AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM n),
 w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, whole GROUP BY term, n_docs),
 m AS (SELECT doc_id, 100 - 90 + (90 * n * n_docs) // n_terms AS m FROM n, whole),
 q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
 s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL),
 r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
""",
}
