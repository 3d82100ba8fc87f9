"""Spelling variants, lexical search and fingerprints against brute force, on awkward rows and at the borders of their tiles."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ratewise.llm import common, content_chunks, lexical, queries, spelling

DATA = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    near = defaultdict(set)
    slots = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            slots[w[:i] + w[i + 1 :]].add(w)
        slots[w].add(w)
    for group in slots.values():
        for a in group:
            near[a] |= {b for b in group if a != b and one_edit(a, b)}
    form = {w: f for w in n if near[w] and n[f := min(near[w], key=lambda x: (-n[x], x))] >= 5 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return sorted(out, key=str)


def test_variants_of_the_table(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").toPandas().itertuples(index=False)
    got = queries.op11_trie_frontier(spark, DATA)
    assert sorted(map(tuple, got.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str) == brute_variants(rows)


def test_variants_of_awkward_words(spark):
    """Repeated letters, chains of forms, ties, words around the trie's longest, letters beyond ASCII and signs between them, nulls."""
    long = "".join(random.Random(4).choices("abcdef", k=90))
    words = {
        "aaaaaa": 5, "aaaaaaa": 30, "aaaaaaaa": 200, "bbbbbb": 6, "abbbbb": 31, "bbbbba": 31, "straße": 7, "strasse": 40, "straßen": 5, "ÀÖàöÿé": 9, "xyzxyz": 5, "zyxzyx": 5, long[:63]: 5, long[:64]: 26, long[:65]: 5, long[:66]: 130,
        long: 6, long[:40] + "z" + long[40:]: 31, long[:80] + "q" + long[81:]: 5, "z" + long[1:]: 5}
    texts = [(i, f" 7×{w}÷ ") for i, (w, c) in enumerate(words.items()) for _ in range(c)]
    rows = [*texts, (None, "nullid " * 5), (1, None), (2, ""), (3, " \t"), *[(4, "ABBBBB abbbbc")] * 3]
    docs = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "doc_id long, text string, word string, node string, n int")
    got = spelling.variants(docs)
    assert sorted(map(tuple, got.collect()), key=str) == brute_variants(rows)
    assert spelling.variants(docs.limit(0)).count() == 0


def test_a_hot_prefix_goes_through_the_broadcast(spark):
    rng = random.Random(8)
    words = list({"inter" + "".join(rng.choices("abc", k=rng.randint(2, 5))) for _ in range(300)} | {"".join(rng.choices("defgh", k=7)) for _ in range(200)})
    table = common.staged(spark.createDataFrame([(w,) for w in words], "word string"), "words")
    scratch = common.Scratch(spark)
    got = {frozenset(r) for r in spelling.near_pairs(table, scratch).collect()}
    rows = spelling.near_pairs(table, scratch).count()
    want = {frozenset((a, b)) for i, a in enumerate(words) for b in words[i + 1 :] if one_edit(a, b)}
    assert got == want and rows == len(want)


def brute_search(docs, items, k=10):
    found = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    counts = [(i, Counter(found(t))) for i, t in docs]
    size, every = sum(1 for _, c in counts if c), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counts:
            m = 10 + (90 * sum(c.values()) * size) // every if every else 0
            s = sum(math.floor(1000 * math.log((2 * size + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(found(text)) if c[t])
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("columns, block", [(4096, 32_768), (7, 40)])
def test_search_with_ties_blocks_and_narrow_tiles(spark, monkeypatch, columns, block):
    """Ties beyond the k-th place, repeated rows and items, nulls, non-ASCII terms; several blocks of items and vocabulary tiles of a few terms."""
    rng = random.Random(1)
    words = [f"w{i}" for i in range(40)] + ["Été", "été", "naïve", "日本", "x9", "9"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(1, 30)))) for i in range(120)]
    docs += [(200 + i, "same words, Same WORDS!") for i in range(15)] + [(7, "w1 w2"), (7, "w1 w2"), (None, "w3 w4"), (None, "w3-w4"), (300, None), (301, ""), (302, " ,;"), (303, "w5 " * 5000)]
    items = [(0, "same words"), (1, "w1 w2 w2 w3"), (1, "w1 w2 w2 w3"), (2, "Été 日本"), (3, None), (4, ""), (5, "nothing here"), (None, "w5"), (6, " ".join(words))]
    monkeypatch.setattr(lexical, "TERM_TILE", columns)
    monkeypatch.setattr(lexical, "DOC_TILE", columns)
    monkeypatch.setattr(lexical, "ITEM_TILE", 3)
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, item long, score string").repartition(5)
    q = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    got = sorted(map(tuple, lexical.search(d, q, block_terms=block).collect()), key=str)
    assert got == brute_search(docs, items)
    assert lexical.search(d.limit(0), q).count() == 0 and lexical.search(d, q.limit(0)).count() == 0


def test_vocabulary_tiles_keep_sums_exact(monkeypatch):
    monkeypatch.setattr(lexical, "EXACT", 10**8)
    weights = np.array([30, 40, 50, 60, 70])
    (items, parts), = lexical._tiles([[0, 1, 2], [2, 3, 4]], weights)
    assert len(items) == 2 and [p.tolist() for p, _ in parts] == [[0, 1], [2], [3], [4]]
    assert all(w.sum(axis=1).max() * lexical.MOST_IMPACT < 10**8 for _, w in parts)


def test_equal_scores_beyond_the_kth_place():
    best = lexical._Best(1, 2)
    for ids in ([9, 8], [3, 7], [5, 1]):
        best.add(np.array([0]), np.full((1, 2), 5), np.array(ids), np.zeros(2, bool))
    assert best.found[0][1].tolist() == [1, 3]


def brute_chunks(text: bytes) -> set:
    """Byte by byte, the hash started anew at each chunk."""
    out, at = set(), 0
    while at < len(text):
        h, end = 0, min(len(text), at + content_chunks.MOST)
        for i in range(at, end):
            h = (2 * h + int(content_chunks._GEAR[text[i]])) & 0xFFFF
            mask = content_chunks.STRICT if i + 1 - at < content_chunks.NORMAL else content_chunks.LOOSE
            if i + 1 - at >= content_chunks.LEAST and not h & mask:
                end = i + 1
                break
        out.add(text[at:end])
        at = end
    return out


def test_chunks_equal_a_scan_byte_by_byte():
    rng = random.Random(2)
    texts = [b"", b"a", bytes(rng.choices(range(256), k=5000)), b"abc " * 900, "é".encode() * 700, bytes(rng.choices(b"ab \n", k=3000))]
    for text, found in zip(texts, content_chunks.chunk_sets(texts), strict=True):
        want = brute_chunks(text)
        assert len(found) == len(want)
        assert sorted((found & np.uint64(0xFFFF)).tolist()) == sorted(map(len, want))


def test_likeness_follows_what_texts_share():
    rng = random.Random(3)
    text = " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(2000)).encode()
    a, b, c, d = content_chunks.chunk_sets([text, text[:5000] + b"inserted" + text[5000:], text[: len(text) // 3], bytes(rng.choices(range(97, 123), k=9000))])
    assert content_chunks.likeness(a, b) > 0.97 and content_chunks.likeness(a, c) > 0.97 and content_chunks.likeness(a, d) < 0.01
    assert (content_chunks.read(content_chunks.written(a)) == a).all()


def test_fingerprints_of_edited_texts(spark):
    """Nulls, empty and long texts, repeated texts and ids, characters beyond the first plane; a table over many ranges and of one row."""
    rng = random.Random(6)
    body = lambda n: "".join(rng.choices("abcdefgh é😀\n", k=n))
    rows = [(i * 7 - 300, body(rng.randint(0, 400))) for i in range(150)] + [(2000, None), (2001, ""), (2002, body(60_000)), (2003, "same"), (2004, "same"), (None, "no id at all")]
    docs = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, range string, guest int").repartition(6)
    got = {r["doc_id"]: r for r in content_chunks.edited_fingerprints(docs).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    prints = {r["doc_id"]: r["fingerprint"] for r in content_chunks.fingerprints(docs).collect()}
    for (i, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        text, after, r = text or "", after or "", got[i]
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        a, b, c = content_chunks.chunk_sets([text.encode(), edited.encode(), after.encode()])
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (content_chunks.written(a), content_chunks.written(b)) and prints[i] == r["fingerprint"]
        assert (r["near_edited"], r["near_next"]) == (content_chunks.likeness(a, b), content_chunks.likeness(a, c))
    alone = content_chunks.edited_fingerprints(docs.filter("doc_id = 2003")).first()
    assert (alone["near_next"], alone["edited_sha256"]) == (1.0, hashlib.sha256(b"sasa").hexdigest())
    assert content_chunks.edited_fingerprints(docs.filter("doc_id is null")).count() == 1 and content_chunks.edited_fingerprints(docs.limit(0)).count() == 0


def test_an_edited_half_stays_near(spark):
    rows = queries.op13_content_chunks(spark, DATA).filter("n_chars > 300").toPandas()
    assert rows["near_edited"].min() > 0.25 and rows["near_edited"].mean() > 0.45 and rows["near_next"].mean() < 0.02
