"""The ten operators against brute force on a small table and on awkward rows."""

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ratewise.llm import exact_dedup, jaccard, langid, licenses, link_trust, mixing, packing, queries, rp_forest, sharding, token_frames, tokens

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, v string, size long, rank int"


def lower(x):
    return (x or "").translate({c: c + 32 for c in range(65, 91)})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def table(docs):
    return docs.toPandas()


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and blank texts, a very long text, repeated rows, one id with two texts, columns with clashing names."""
    long = " ".join(f"w{i % 7919}" for i in range(60_000))
    rows = [
        (1, "the mit license of a small text here", "en", "a"), (1, "the mit license of a small text here", "en", "a"), (1, "another text under this same id now", "en", "a"), (2, "", "en", None), (3, None, None, "b"), (4, " \t\n ", "en", "b"),
        (None, "some words that have no id at all", None, "b"), (5, long, "fr", "b"), (6, long + " end", "fr", "c"), (7, "The  MIT license of a small text HERE", "en", "c"), (8, "12 34 !!", "fr", "c"), (9, "één mot", "fr", "c"),
    ]
    return spark.createDataFrame([(*r, None, "x", "y", 3, 1) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


OPERATORS = {
    "mix": mixing.mix, "jaccard": jaccard.similar_groups, "frames": lambda d: token_frames.encode_corpus(d, str(public_tokenizers.path("byte_bpe_50k.json"))), "exact": exact_dedup.exact_groups,
    "language": langid.identify, "shards": sharding.interleaved_shards, "licenses": licenses.scan, "dedup": exact_dedup.deduplicated, "one": jaccard.one_of_each, "mixed": mixing.mixed, "with_language": langid.with_language,
    "pack": lambda d: packing.pack(d, str(public_tokenizers.path("word_bpe_49k.json"))),
}
ROW_FOR_ROW = ("mix", "jaccard", "frames", "exact", "language", "shards", "licenses")


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_and_empty_tables(awkward, empty, name):
    n = len(OPERATORS[name](awkward).collect())
    assert n == 12 if name in ROW_FOR_ROW else n > 0
    assert OPERATORS[name](empty).collect() == []


def shingles(text, size=5):
    w = WORD.findall(lower(text))
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def test_jaccard_groups(docs, table):
    sets = {i: shingles(t) for i, t in zip(table.doc_id, table.text, strict=True)}
    ids, root = sorted(sets), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            o = len(sets[a] & sets[b])
            if o and 100 * o >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_groups(docs).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in ids}


def test_jaccard_lists_with_several_groups(spark):
    """Near copies in a chain and sets that share index lists without a link: steps beyond the leaders."""
    rng = np.random.default_rng(1)
    base, rows = [f"b{i}" for i in range(80)], []
    for i in range(60):
        w = list(base)
        for k in rng.choice(80, int(rng.integers(0, 6)), replace=False):
            w[k] = f"x{int(rng.integers(0, 6))}"
        rows.append((i, " ".join(w)))
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if root[b] < root[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a], changed = root[b], True
    assert len(set(root.values())) > 1
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == root


def test_every_link_between_different_sets_is_found(spark):
    """Near copies that are all tied to one another by their links with a leader, and copies of some."""
    rng = np.random.default_rng(2)
    rows = []
    for g in range(4):
        base = [f"g{g}w{k}" for k in range(60)]
        for _ in range(12):
            w = list(base)
            for k in rng.choice(60, int(rng.integers(0, 4)), replace=False):
                w[k] = f"x{int(rng.integers(0, 5))}"
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + k, rows[k][1]) for k in range(5)] + [(100, None), (101, "short text")]
    sets = {i: shingles(t) for i, t in rows}
    want = {(a, b) for a in sets for b in sets if a != b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["n_links"] for r in jaccard.similar_groups(docs).collect()}
    assert got == {i: sum(a == i for a, _ in want) for i in sets}
    members, links = (x.collect() for x in jaccard.linked_sets(docs))
    node = {r["doc_id"]: r["node"] for r in members}
    pairs = [(r["a"], r["b"]) for r in links]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(node[a], node[b]) for a, b in want if node[a] < node[b]}


def test_exact_groups_match_sql(docs, table):
    documents = table  # noqa: F841
    want = duckdb.sql(queries.SQL["op6_exact_dedup"]).df().sort_values("doc_id").reset_index(drop=True)
    got = exact_dedup.exact_groups(docs).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert got[want.columns].astype(str).equals(want.astype(str))


def test_texts_that_share_a_digest_are_told_apart(docs):
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(exact_dedup.exact_groups(docs, digest_digits=1, bucket_keys=2)) == key(exact_dedup.exact_groups(docs))


def test_directory_doubles():
    """Full buckets split on their next bit, shallow ones share slots; owners have ranges of buckets of even weight."""
    cells = {c: 1 for c in range(0, 1 << 16, 64)} | {c: 50 for c in range(8)}
    depth, slots = exact_dedup.directory(cells, 60)
    assert len(slots) == 1 << depth and depth > 5
    held = Counter()
    for cell, n in cells.items():
        held[slots[cell >> (16 - depth)]] += n
    assert max(held.values()) <= 60 and len({d for _, d in slots}) > 3  # buckets of several depths
    for i, (prefix, local) in enumerate(slots):
        assert prefix == i >> (depth - local)
    owner = exact_dedup.owners_of(slots, cells, depth, 10)
    order = [owner[b] for b in dict.fromkeys(slots)]
    assert order == sorted(order) and set(order) == set(range(10))
    weight = Counter()
    for b, n in held.items():
        weight[owner[b]] += n
    assert max(weight.values()) < 2 * sum(weight.values()) / 10
    assert exact_dedup.directory({}, 5) == (0, [(0, 0)])


def test_dedup_runs_through_a_deep_directory(docs):
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(exact_dedup.exact_groups(docs, bucket_keys=3)) == key(exact_dedup.exact_groups(docs, bucket_keys=10**6))


def test_mix_meets_targets(docs, table):
    got = mixing.mix(docs).toPandas().set_index("doc_id")
    words = table.set_index("doc_id").text.map(lambda t: len(WORD.findall(t or "")))
    assert got["size"].to_dict() == words.to_dict()
    assert (got.taken <= 3 * got["size"]).all()
    by = got.groupby("source_size").agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((by.taken - by.target).abs() <= np.maximum(0.02 * by.target, 20)).all()
    assert abs(got.groupby("source_size").target.first().sum() - got["size"].sum()) < 1e-3


def test_nearest_neighbours(spark):
    v = spark.read.parquet(f"{DATA}/embeddings.parquet")
    t = v.toPandas()
    x = np.stack(t.embedding).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, got, hits, n = t.vec_id.to_numpy(), rp_forest.neighbours(v).toPandas(), 0, 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = x @ x[q]
        s[q] = -9
        mine = got[got.query_id == ids[q]].sort_values("rank")
        hits, n = hits + len(set(mine.vec_id) & set(ids[np.argsort(-s)[:5]])), n + 5
        assert np.allclose(mine.score, [s[np.flatnonzero(ids == i)[0]] for i in mine.vec_id])
    assert hits / n >= 0.9


def test_neighbours_of_copies_and_bad_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(0, 60)] + [(100, [0.0, 0.0]), (101, None), (102, [1.0, None]), (103, [1.0, float("nan")]), (104, [1.0]), (150, [0.0, 1.0])]
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in rp_forest.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    first = lambda q: [i for i in range(60) if i != q][:5]
    assert got == [(q, k + 1, i) for q in (0, 50, 150) for k, i in enumerate(first(q))]
    assert rp_forest.neighbours(spark.createDataFrame([], "vec_id long, embedding array<double>")).collect() == []


def test_token_files_round_trip(docs, table):
    t = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    got, start = {r["doc_id"]: r for r in token_frames.encode_corpus(docs, str(public_tokenizers.path("byte_bpe_50k.json"))).collect()}, 0
    for i, text in sorted(zip(table.doc_id, table.text, strict=True)):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


SPECIAL = ["<|endoftext|>", "one word<|endoftext|>inside of it", "after blanks  \n <|endoftext|> and on", "<|startoftext|> a <|ENDOFTEXT|>", "<|endof text|> is none", "plain text", None]


@pytest.mark.parametrize(("name", "keeps_space"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
@pytest.mark.parametrize("most", [50, tokens.MOST_PIECES])
def test_pieces_split_at_signs_match_the_library(name, keeps_space, most):
    import random

    import pyarrow as pa

    random.seed(5)
    parts = [*"aBjJHtTwWyYsS", "'s", "'RE", "'ll", "can't", "Word", "WORD", *".,;(){}<>|=-_'\"`~12", "\u030c", "\u0331", "\u0308", "\u030a", "\u0338", "\u0307", "é", "Å", "ß", "Σ", "漢", "🙂", " ", "  ", "\n", "\t ", "\r\n", "<|endoftext", "|>"]
    texts = ["".join(random.choices(parts, k=random.randint(0, 25))) for _ in range(3000)] + [None, "", "J", "\u030c", "a<|endoftext|>b"]
    whole = Tokenizer.from_file(str(public_tokenizers.path(name)))
    got = tokens.Encoder(str(public_tokenizers.path(name)), keeps_space, most).encode(pa.array(texts))
    for text, ids in zip(texts, got, strict=True):
        assert ids.tolist() == whole.encode(text or "", add_special_tokens=False).ids, text


def test_added_tokens_match_the_library(spark):
    import pyarrow as pa

    for name, keeps_space in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        t = Tokenizer.from_file(str(public_tokenizers.path(name)))
        got = tokens.Encoder(str(public_tokenizers.path(name)), keeps_space).encode(pa.array(SPECIAL))
        assert [x.tolist() for x in got] == [t.encode(x or "", add_special_tokens=False).ids for x in SPECIAL]
    docs = spark.createDataFrame(list(enumerate(SPECIAL)), "doc_id long, text string")
    t, start = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json"))), 0
    for r in token_frames.encode_corpus(docs, str(public_tokenizers.path("byte_bpe_50k.json"))).orderBy("doc_id").collect():
        ids = np.array([*t.encode(SPECIAL[r["doc_id"]] or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_damaged_frame_is_found():
    image = bytearray(token_frames.file_image(0, 0, [1, 2], [b"\x01\x00" * 50, b"\x02\x00" * 50], 2))
    reader = token_frames.FrameReader(bytes(image))
    assert reader.document(1).tolist() == [2] * 50
    image[reader.at[2] + 9] ^= 1
    with pytest.raises(Exception):
        token_frames.FrameReader(bytes(image)).document(1)


def test_language_of_held_out_rows(docs, table):
    got = langid.identify(docs).toPandas().set_index("doc_id").join(table.set_index("doc_id").lang)
    held = got[got.held_out & got.lang.notna() & (got.lang_pred != "und")]
    assert (held.lang == held.lang_pred).mean() > 0.9
    assert got.score.between(0, 1).all()


def test_shards_hold_equal_counts(docs):
    got = sharding.interleaved_shards(docs).toPandas()
    counts = Counter(got["shard"])
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    each = got.groupby(["shard", got.source.fillna("")]).size().unstack(fill_value=0)
    assert (each.max() - each.min()).max() <= 2


def test_packing_is_whole_and_tight(docs):
    got = packing.pack(docs, str(public_tokenizers.path("word_bpe_49k.json"))).toPandas()
    for _, bin_ in got.groupby("sequence_id"):
        b = bin_.sort_values("offset")
        assert b.length.sum() <= 4096 and b.offset.tolist() == [0, *b.length.cumsum().tolist()[:-1]]
    assert got.sequence_id.nunique() <= -(-int(got.length.sum()) // 4096) * 1.1 + 1
    assert (got.groupby("doc_id").length.sum() == got.groupby("doc_id").apply(lambda g: (g.start + g.length).max(), include_groups=False)).all()


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_every_capacity_holds(score):
    counts = np.zeros(101, np.int64)
    counts[[5, 20, 33, 60, 100]] = [40, 13, 7, 9, 2]
    limits = packing.Limits(tokens=100, documents=4, attention=5000 + 100 * 100)
    tokens, pieces = Counter(), Counter()
    for length, _, n, first, _ in packing.plan(counts, limits, score).tolist():
        for s in range(first, first + n):
            tokens[s] += length
            pieces[s] += 1
    assert max(tokens.values()) <= 100 and max(pieces.values()) <= 4 and sum(pieces.values()) == counts.sum()


def test_base_phrases(docs, table):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    for i, text in zip(table.doc_id, table.text, strict=True):
        w = word.findall(lower(text))
        places = [(k, label) for p, label in licenses.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(places), ",".join(sorted({x for _, x in places})))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))


def test_contained_hits_are_suppressed(spark):
    text = "Under the GNU Lesser General Public License, version 2.1 and the Apache License 2.0"
    r = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r["labels"] == "apache,gpl,lgpl" and r["base_labels"] == "apache,gpl"  # the base place stays
    assert {h["label"] for h in r["hits"]} == {"apache", "lgpl"}
    assert [(h["first"], h["last"]) for h in r["hits"] if h["label"] == "apache"] == [(12, 15)]  # words, both ends included


SHORT_FORMS = {
    "GPLv3": "gpl", "LGPL-2.1": "lgpl", "AGPL": "agpl", "MPL-2.0": "mpl", "License: MIT": "mit", "License: Apache-2.0": "apache", "BSD-3-Clause": "bsd", "see the Unlicense here": "unlicense",
    "Microsoft Reciprocal License": "ms-rl", "Microsoft Public License": "ms-pl", "SPDX-License-Identifier: GPL-2.0": "gpl", "SPDX-License-Identifier: MIT": "mit", "under CC0-1.0": "cc0", "0BSD": "0bsd",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer": "bsd", "The origin of this software must not be misrepresented": "zlib",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0": "mpl", "a plain text on bread": "",
}


def test_short_forms_ids_and_sentences(spark):
    got = {r["t"]: r["labels"] for r in licenses.scan(spark.createDataFrame([(t, t) for t in SHORT_FORMS], "t string, text string"), "t").withColumnRenamed("doc_id", "t").collect()}
    assert {t: set(x.split(",")) - {"spdx"} if x else set() for t, x in got.items()} == {t: {x} if x else set() for t, x in SHORT_FORMS.items()}
    assert all(len(f) == 4 and f[1] for f in licenses.HAND)


def test_url_rules(spark):
    urls = ["http://A.example.com/en/7?x", "http://example.com/en/1", "https://b.example.net/de/81", "x://net/de/", "nothing", None, "http://badexample.com/en/7", "http://q.org#/es/"]
    rows = [(i, u, '<a href="http://a.example.com/">x</a>' if i % 2 else None) for i, u in enumerate(urls)]
    got = [(r["host"], r["path"], r["rule"]) for r in link_trust.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]
    assert got == [
        ("a.example.com", "/en/7", "example.com/en/7"), ("example.com", "/en/1", "com/en/"), ("b.example.net", "/de/81", "example.net/de/8"), ("net", "/de/", "net/de/"),
        ("", "", None), ("", "", None), ("badexample.com", "/en/7", "com/en/"), ("q.org", "", None)]
    assert link_trust.judge_urls(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_propagation_matches_power_iteration(spark):
    edges, hosts = [("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("c", "a", 3), ("d", "c", 1)], "abcd"
    m = np.zeros((4, 4))
    for s, t, n in edges:
        m[hosts.index(t), hosts.index(s)] = n
    m /= m.sum(0)
    seed = np.array([0.5, 0, 0, 0.5])
    x = seed
    for _ in range(8):
        x = 0.85 * m @ x + 0.15 * seed
    got = link_trust.propagate(spark.createDataFrame(edges, "src string, dst string, links long"), spark.createDataFrame([("a", 0.5), ("d", 0.5)], "host string, seed double"))
    assert all(abs(r["score"] - x[hosts.index(r["host"])]) < 1e-9 for r in got.collect())


def test_scores_settle(spark):
    """A cycle against the solved equations, and a host twelve links upstream of a blocked one, half of its links protocol-relative."""
    edges, hosts = [("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("c", "a", 3), ("d", "c", 1)], "abcd"
    m = np.zeros((4, 4))
    for s, t, n in edges:
        m[hosts.index(t), hosts.index(s)] = n
    m /= m.sum(0)
    x = np.linalg.solve(np.eye(4) - 0.85 * m, 0.15 * np.array([0.5, 0, 0, 0.5]))
    got = link_trust.propagate(spark.createDataFrame(edges, "src string, dst string, links long"), spark.createDataFrame([("a", 0.5), ("d", 0.5)], "host string, seed double"), rounds=None)
    assert all(abs(r["score"] - x[hosts.index(r["host"])]) < 1e-8 for r in got.collect())
    chain = [(k, f"http://h{k}.x/", f'<a href="{"http:" if k % 2 else ""}//H{k + 1}.x/p?u=http://o.x/">x</a>') for k in range(12)] + [(12, "http://h12.x/bad", None)]
    r = {r["page_id"]: r for r in link_trust.judge_urls(spark.createDataFrame(chain, "page_id long, url string, html string"), rules=(("h12.x", "/bad", "block"),)).collect()}
    assert [r[k]["verdict"] for k in range(13)] == ["block"] * 13 and abs(r[0]["distrust"] / (0.15 * 0.85**12) - 1) < 1e-6


def test_letters_alone_decide_without_labels(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "12 !!", None), (3, None, None), (4, "mot", None)], "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in langid.with_language(docs).collect()) == [1, 4]


def test_mixed_takes_what_the_mix_decides_where_ids_repeat(spark):
    rows = [(None if i % 2 else 7, f"w{i % 30} b c", "abc"[i % 3], i) for i in range(90)] + [(5, "the same text", "a", 100 + i) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row int")
    want = Counter({r["source"]: 0 for r in mixing.mix(docs).collect()})
    for r in mixing.mix(docs).collect():
        want[r["source"]] += r["copies"]
    got = mixing.mixed(docs)
    assert got.columns == docs.columns and Counter(r["source"] for r in got.collect()) == want


def test_pipeline_stages(spark, docs, table):
    import corpus_pipeline

    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, DATA)
        assert kept.columns == docs.columns, name
    groups = {r["doc_id"]: r["component_id"] for r in jaccard.similar_groups(docs).collect()}
    lettered = {i for i, t in zip(table.doc_id, table.text, strict=True) if t and any(c.isalpha() for c in t)}
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and {groups[i] for i in ids} == {groups[i] for i in lettered}
    final = corpus_pipeline.run(spark, DATA).toPandas()
    assert set(final.doc_id) <= set(ids) and final.groupby("sequence_id").length.sum().max() <= 4096
    language = {r["doc_id"]: (r["lang"], r["source"]) for r in kept.select("doc_id", "lang", "source").collect()}
    assert all(language[i] == (lang, source) for i, lang, source in zip(final.doc_id, final.lang, final.source.where(final.source.notna(), None), strict=True)) and final.lang.notna().all()
