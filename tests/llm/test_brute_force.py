"""Whole results of the operators against plain Python, selective reading, and values of awkward rows."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ratewise.llm import common, exact_dedup, jaccard, langid, licenses, link_trust, mixing, packing, sharding, token_frames

DATA = "/root/testdata/sf0.001"
SPACE, WORD = re.compile(r"[\x20\x09-\x0D]+"), re.compile(r"[^\x20\x09-\x0D]+")
BYTE_BPE, WORD_BPE = (str(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
#: Names that the operators use themselves.
CLASHING = "row size rank v h g u gl taken whole chosen copies target shard slot place total score labels hits lang_pred keep_id kept node component_id digest norm cell owner piece start length task nth _id _copy _sha _sha256 _h _g _size _k _copies _guess".split()


def lower(x):
    return (x or "").translate({c: c + 32 for c in range(65, 91)})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


LONG = " ".join(f"w{i % 7919}" for i in range(30_000))
AWKWARD = [
    (1, "the mit license of a small text here", "en", "a"), (1, "the mit license of a small text here", "en", "a"), (1, "another text under this same id now", "en", "a"), (2, "", "en", None), (3, None, None, "b"),
    (4, " \t\n ", "en", "b"), (None, "some words that have no id at all", None, "b"), (5, LONG, "fr", "b"), (6, LONG + " end", "fr", "c"), (7, "The  MIT license of a small text HERE", "en", "c"), (8, "12 34 !!", "fr", "c"), (9, "één mot", "fr", "c"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    df = spark.createDataFrame(AWKWARD, "doc_id long, text string, lang string, source string")
    return df.select("*", *[F.lit(k).alias(n) for k, n in enumerate(CLASHING)])


def by_id(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))


def ordered(values):
    return sorted(values, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))


def pieces_of(text, most=4096):
    ids = np.array([*Tokenizer.from_file(WORD_BPE).encode(text or "", add_special_tokens=False).ids, 1], "<u4")
    return [(k, a, len(ids[a : a + most]), zlib.crc32(ids[a : a + most].tobytes())) for k, a in enumerate(range(0, len(ids), most))]


def test_pieces_match_the_library(docs, rows):
    t, want = Tokenizer.from_file(WORD_BPE), []
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    assert by_id(packing.pack(docs, WORD_BPE), "doc_id", "piece", "start", "length", "ids_crc32") == ordered(want)
    kept = packing.pack(docs, WORD_BPE, keep=("lang", "source"))
    assert kept.columns[7:] == ["lang", "source"] and by_id(kept.select(*kept.columns[:5]), "doc_id", "piece", "start", "length", "ids_crc32") == ordered(want)
    own = {tuple(r) for r in docs.select("doc_id", "lang", "source").collect()}
    assert {tuple(r) for r in kept.select("doc_id", "lang", "source").collect()} == own
    with pytest.raises(ValueError, match="columns of a piece"):
        packing.pack(docs.withColumn("rank", F.lit(1)), WORD_BPE, keep=("rank",))


def test_token_files_match_the_library_and_are_read_by_document(spark, docs, rows):
    path, t = common.new_path(spark, "test-files"), Tokenizer.from_file(BYTE_BPE)
    token_frames.write_token_files(docs, path, BYTE_BPE, file_bytes=20_000)
    want = {i: [*t.encode(text or "", add_special_tokens=False).ids, 0] for i, text in rows}
    some = sorted(want)[3::17]
    got = token_frames.read_token_files(spark, path, some).collect()
    assert sorted(r["doc_id"] for r in got) == some and all(r["ids"] == want[r["doc_id"]] for r in got)
    before = np.cumsum([0, *[len(want[i]) for i in sorted(want)]])
    place = token_frames.corpus_positions(spark, path).collect()
    assert {r["doc_id"]: (r["start"], r["n_tokens"]) for r in place} == {i: (int(b), len(want[i])) for i, b in zip(sorted(want), before, strict=False)}


def reachable(lengths, counts):
    sums = {0}
    for length, n in zip(lengths.tolist(), counts.tolist(), strict=True):
        sums = {s + k * length for s in sums for k in range(n + 1)}
    return sums


@pytest.mark.parametrize("window", [1 << 16, 64])
def test_budgets_are_fitted_as_by_subset_sum(window):
    """Never farther from the budget than the nearest subset sum by more than the longest length; mostly just as near."""
    rng, exact = np.random.default_rng(3), 0
    for _ in range(200):
        lengths = np.sort(rng.choice(np.arange(1, 90), int(rng.integers(1, 7)), replace=False)).astype(np.int64)
        counts = rng.integers(1, 9, len(lengths))
        budget = int(rng.integers(0, int((lengths * counts).sum()) + 1))
        chosen = mixing.fit_counts(lengths, counts, budget, window)
        assert (chosen >= 0).all() and (chosen <= counts).all()
        best = min(abs(budget - s) for s in reachable(lengths, counts))
        miss = abs(budget - int((lengths * chosen).sum()))
        assert best <= miss <= best + lengths.max()
        exact += miss == best
    assert exact == 200 if window > 1000 else exact >= 150


def test_window_cannot_miss_on_a_histogram_of_texts():
    """A budget far above the window ends as near as one within it: short lengths are many."""
    lengths, counts = np.arange(1, 3000), np.maximum(1, 4000 // np.arange(1, 3000))
    for budget in (123_457, 1_234_567, 2_345_679):
        for window in (1 << 16, 1 << 12):
            assert int((lengths * mixing.fit_counts(lengths, counts, budget, window)).sum()) == budget


def test_a_large_budget_takes_each_length_in_proportion():
    """Beyond the words of the window, which the shortest lengths fill, no length is more than a document off its share, however large the budget."""
    lengths, counts = np.arange(1, 2001), np.full(2000, 1000)
    for budget in (867_433_711, 123_456_789, 1_999_999_999):
        chosen, share = mixing.fit_counts(lengths, counts, budget), 1000 * budget / int((lengths * counts).sum())
        assert int((lengths * chosen).sum()) == budget
        assert np.abs(chosen - share)[100:].max() <= 1 and (lengths * np.abs(chosen - share))[:100].sum() <= 3 * mixing.WINDOW


def test_documents_longer_than_the_window():
    """Where only such documents are free, the nearest sum of them counts."""
    assert mixing.fit_counts(np.array([3, 100]), np.array([4, 3]), 195, window=16).tolist() in ([0, 2], [4, 2])
    assert mixing.fit_counts(np.array([100]), np.array([7]), 349, window=16).tolist() == [3]
    assert mixing.fit_counts(np.array([100]), np.array([7]), 351, window=16).tolist() == [4]


def test_a_document_above_the_budget_is_taken_where_it_is_nearer():
    assert mixing.fit_counts(np.array([8, 30_000]), np.array([1, 1]), 29_988).tolist() == [0, 1]
    assert mixing.fit_counts(np.array([8, 30_000]), np.array([1, 1]), 15_000).tolist() == [1, 0]


def test_shards_follow_fractional_ranks(docs):
    text = F.coalesce("text", F.lit(""))
    drawn = docs.select("doc_id", F.coalesce(F.concat(F.lit("v"), "source"), F.lit("n")).alias("g"), F.octet_length(text).alias("b"), F.crc32(text.cast("binary")).alias("c"))
    drawn = drawn.withColumn("u", common.seeded_unit(11, F.col("doc_id"), F.col("c"), (F.col("b") + 1).cast("bigint"))).collect()
    groups = defaultdict(list)
    for r in drawn:
        groups[r["g"]].append((r["u"], r["doc_id"]))
    line = sorted(((k + 0.5) / len(g), u, name, i) for name, g in groups.items() for k, (u, i) in enumerate(sorted(g)))
    few, more = divmod(len(line), 16)
    sizes = [few + (s < more) for s in range(16)]
    want, at = {}, 0
    for s, n in enumerate(sizes):
        want |= {line[at + k][3]: (s, k) for k in range(n)}
        at += n
    got = sharding.interleaved_shards(docs).collect()
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in got} == want
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == {r["doc_id"]: (r["b"] + 1, r["c"]) for r in drawn}


def test_verdicts_match_solved_equations(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    extra = spark.createDataFrame([(9001, "http://one.test/", '<a href="http://example.com/en/1">x</a><A HREF=//two.test/a>y</a>'), (9002, "http://two.test/q?x", "<a href='https://Example.net/de/8'>x</a>"), (9003, "http://three.test", None), (9003, None, "<a href='http://one.test'>")], pages.schema)
    pages = pages.unionByName(extra)
    table = [(r["page_id"], r["url"], r["html"]) for r in pages.collect()]

    def split(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        return lower(host), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]

    def rule(host, path):
        fits = [(len(h + p), h + p, v) for h, p, v in link_trust.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1:] if fits else (None, None)

    edges, good, bad = Counter(), Counter(), Counter()
    for host in {split(u)[0] for _, u, _ in table}:
        parts = host.split(".")
        for k in range(1, len(parts) - 1):
            edges[host, ".".join(parts[k:])] += 1
    for _, url, html in table:
        host, path = split(url)
        for link in re.findall(r"""(?i)href\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)""", html or ""):
            edges[host, split("http:" + link if link.startswith("//") else link)[0]] += 1
        v = rule(host, path)[1]
        good[host] += v == "allow"
        bad[host] += v == "block"
    edges = {e: n for e, n in edges.items() if e[0] != e[1] and e[0] and e[1]}
    hosts = sorted({h for e in edges for h in e} | set(good))

    def solved(pairs, seeds):
        m, at = np.zeros((len(hosts), len(hosts))), {h: k for k, h in enumerate(hosts)}
        for (s, d), n in pairs.items():
            m[at[d], at[s]] += n
        m /= np.maximum(m.sum(0), 1)
        seed = np.array([seeds[h] for h in hosts], float)
        return dict(zip(hosts, np.linalg.solve(np.eye(len(hosts)) - 0.85 * m, 0.15 * seed / max(1, seed.sum())), strict=True))

    trust, distrust = solved(edges, good), solved({(d, s): n for (s, d), n in edges.items()}, bad)
    want = []
    for i, url, _ in table:
        host, path = split(url)
        name, verdict = rule(host, path)
        want.append((i, host, path, name, verdict or ("block" if host and distrust[host] > trust[host] * (1 + 1e-9) else "allow")))
    got = link_trust.judge_urls(pages).collect()
    assert ordered([(r["page_id"], r["host"], r["path"], str(r["rule"]), r["verdict"]) for r in got]) == ordered([(i, h, p, str(n), v) for i, h, p, n, v in want])
    assert all(abs(r["trust"] - trust[r["host"]]) < 1e-7 and abs(r["distrust"] - distrust[r["host"]]) < 1e-7 for r in got if r["host"])


def scanned(text):
    """Labels by a plain scan: every rule tried, intervals of words, contained ones of lower rank out, base places added."""
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text)) if w]
    line, hits = " " + " ".join(words) + " ", []
    for label, keyword, regex, priority in licenses.rules():
        if f" {keyword} " in line:
            for m in re.finditer(rf"(?<= ){regex}(?= )", line):
                first = line[: m.start()].count(" ") - 1
                hits.append((first, first + m[0].count(" "), priority, label))
    left = [x for x in hits if not any(y[0] <= x[0] and y[1] >= x[1] and (y[2] > x[2] or y[2] == x[2] and y[1] - y[0] > x[1] - x[0]) for y in hits)]
    base = {label for p, label in licenses.BASE if f" {p} " in line}
    return ",".join(sorted(base | {x[3] for x in left})), Counter(left)


LICENSED = [
    "Released under the GNU GPL version 3 or later; parts are MIT licensed, see LICENSE.Apache-2.0", "SPDX-License-Identifier: LGPL-2.1-or-later and GNU Lesser General Public License", "Apache License Version 2.0, apache license 2.0 and the Apache Software License",
    "Mozilla Public License 2.0 (MPL-2.0). All rights reserved.", "GPL GPL gpl v2 LGPL lgpl, BSD-2-Clause BSD-3-Clause", "CC BY-SA 4.0, CC0 1.0 Universal, dedicated to the public domain",
    "Permission is hereby granted, free of charge, to any person obtaining a copy", "GNU Affero General Public License version 3 general public license", "mit license mit license", None, "",
]


def test_labels_match_a_plain_scan(spark, docs):
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + k, t) for k, t in enumerate(LICENSED)], "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] for r in table.collect()}
    for r in licenses.scan(table).collect():
        labels, hits = scanned(texts[r["doc_id"]])
        assert (r["labels"], Counter((h["first"], h["last"], h["priority"], h["label"]) for h in r["hits"])) == (labels, hits), texts[r["doc_id"]]


def test_presence_and_scores_of_the_string_kernel():
    texts = ["Bonjour le monde", "a", "", "the cat sat on the mat", "één mot", "x1y2"]
    raw = [t.encode() for t in texts]
    table = bytes(32 if c < 128 and not (65 <= c <= 90 or 97 <= c <= 122) else (c + 32 if 65 <= c <= 90 else c) for c in range(256))
    grams = [{t.translate(table)[k : k + n] for n in range(1, 5) for k in range(len(t) - n + 1)} for t in raw]
    flags = langid.presence(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert all(0 <= len(g) - f.sum() <= 2 for g, f in zip(grams, flags, strict=True))  # of 2**14 places hardly any is shared
    labels = np.array([0, 1, 0, 1, 0, 1])
    model = langid.solve(flags[[0, 1, 3, 4, 5]], labels[[0, 1, 3, 4, 5]], ["p", "q"], landmarks=10, ridge=1e-3)
    x = flags[[0, 1, 3, 4, 5]].astype(float)
    k = x @ x.T / np.sqrt(np.outer(x.sum(1), x.sum(1)))
    h, y = np.eye(5) - 0.2, np.where(labels[[0, 1, 3, 4, 5]][:, None] == np.arange(2), 1.0, -1.0)
    direct = (h @ k @ h) @ np.linalg.solve(h @ k @ h + 1e-3 * 5 * np.eye(5), y - y.mean(0)) + y.mean(0)  # all rows are landmarks: the kernel itself
    assert np.allclose(model.scores(flags[[0, 1, 3, 4, 5]]), direct, atol=1e-3)


def test_values_of_awkward_rows(awkward):
    texts = [(i, t or "") for i, t, _, _ in AWKWARD]
    size = lambda t: len(WORD.findall(t))
    taken = mixing.mix(awkward).collect()
    assert ordered([(r["doc_id"], r["size"]) for r in taken]) == ordered([(i, size(t)) for i, t in texts])
    assert all(r["taken"] == r["size"] * r["copies"] and 0 <= r["copies"] <= 3 for r in taken)
    assert by_id(packing.pack(awkward, WORD_BPE), "doc_id", "piece", "start", "length", "ids_crc32") == ordered([(i, *p) for i, t in texts for p in pieces_of(t)])
    norm = [(i, SPACE.sub(" ", t)) for i, t in texts]
    groups = defaultdict(list)
    for i, t in norm:
        groups[t].append(i)
    least = {t: min((x for x in g if x is not None), default=None) for t, g in groups.items()}
    assert by_id(exact_dedup.exact_groups(awkward), "doc_id", "keep_id", "group_size") == ordered([(i, least[t], len(groups[t])) for i, t in norm])
    shards = sharding.interleaved_shards(awkward).collect()
    assert ordered([(r["doc_id"], r["size"], r["text_crc32"]) for r in shards]) == ordered([(i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts])
    assert max(Counter(r["shard"] for r in shards).values()) == 1
    lettered = lambda t: any(c.isalpha() for c in t)
    assert Counter((r["doc_id"], r["lang_pred"] == "und") for r in langid.identify(awkward).collect()) == Counter((i, not lettered(t)) for i, t in texts)
    assert Counter((r["doc_id"], r["labels"]) for r in licenses.scan(awkward).collect()) == Counter((i, scanned(t)[0]) for i, t in texts)


def test_clashing_columns_stay_as_they_are(awkward):
    whole = Counter(tuple(r) for r in awkward.collect())
    for f in (langid.with_language, exact_dedup.deduplicated, jaccard.one_of_each, mixing.mixed):
        got = f(awkward)
        assert got.columns == awkward.columns, f
        keep = [c for c in awkward.columns if c != "lang"]  # with_language fills null languages
        known = {tuple(r) for r in awkward.select(keep).collect()}
        assert got.count() > 0 and all(tuple(r) in known for r in got.select(keep).collect()), f
    assert Counter(tuple(r) for r in exact_dedup.deduplicated(awkward).collect()) <= whole


def test_pipeline_with_awkward_rows(spark, awkward, tmp_path):
    import corpus_pipeline

    awkward.select("doc_id", "text", "lang", "source", "size").withColumnRenamed("size", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # of equal and near texts one stays: 1 (twice, and 7 but for case) and 5, 6; letterless ones go
    assert {r["doc_id"] for r in got} <= {1, 5, 9, None} and {1, 5} <= {r["doc_id"] for r in got}
    ends = defaultdict(list)
    for r in got:
        ends[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in ends.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096


def test_pipeline_stages_mix_and_pack(spark, docs):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    taken = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect() if r["size"]}
    mixed = common.staged(stages["mix"](spark, docs, DATA), "test-mixed")
    assert Counter(r["doc_id"] for r in mixed.select("doc_id").collect()) == Counter({i: n for i, n in taken.items() if n})
    texts = Counter((r["doc_id"], r["text"]) for r in mixed.select("doc_id", "text").collect())
    want = Counter()
    for (i, t), n in texts.items():
        for p in pieces_of(t) if len(t) > 20_000 else [None]:
            want[i] += n if p else 0
    pieces = stages["pack"](spark, mixed, DATA).collect()
    starts = Counter(r["doc_id"] for r in pieces if r["piece"] == 0)
    assert starts == Counter({i: n for (i, _), n in texts.items()})
    assert all(Counter(r["doc_id"] for r in pieces)[i] == n for i, n in want.items() if n)
