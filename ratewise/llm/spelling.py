"""Spelling variants of a corpus' words by a relational trie frontier.

The words are the paths of a trie whose edges are a distributed table. States (word, position, node, edits) are joined
with it level by level: an unedited state stands at its own prefix and spends its one edit on another letter or on
skipping one of its own; an edited one follows its remaining letters. States that end on a word with one edit are
neighbours. Of each pair only one direction is walked: the smaller word replaces a letter, the longer one skips it.

An edge knows the numbers of letters that may follow it and, as bits, the next letters, so most states die before they
are written. A node that over 1 in HEAVY words pass is heavy: a level has at most HEAVY of them, with at most 90 edges
each (26 letters and 64 of Latin-1), and those edges are broadcast; the rest is joined by node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewise.llm import common

#: Words have so many code points and occurrences at least.
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A run loses a letter where this divides its checksum.
SLIP = 199
#: A word is written as its commonest neighbour if that is so many times as common.
RATIO = 5
#: Longest word of the trie; a pair with a longer word is found by equal halves.
LONG = 64
#: A level's nodes that more than one in so many words pass are joined by broadcast.
HEAVY = 256

_RUN = f"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}+"


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: lower-cased runs of letters, some with a letter lost as their checksum decides, of LEAST_LENGTH letters and LEAST_COUNT occurrences or more.

    Shorter runs cannot become words and are not taken out of a text at all. A null text has no run; a null id counts as an empty one.
    """
    runs = docs.select(F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("i"), F.explode(F.regexp_extract_all(common.ascii_lower(docs[text_col]), F.lit(_RUN), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("i", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(h % SLIP == 0, slipped).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _letter(word: str | Column, at) -> Column:
    """The letter at a position from 0; empty beyond the end."""
    return F.substring(word, F.lit(at) + 1 if isinstance(at, int) else at + 1, F.lit(1))


def _bit(letter: Column) -> Column:
    return F.ascii(letter) % 63


def trie_edges(words: DataFrame) -> DataFrame:
    """depth, node (the prefix), ch, passing (words), rests and nexts: bits of the numbers of letters and of the letters that follow."""
    depth = F.col("depth")
    steps = words.select("word", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("depth"))
    steps = steps.select("depth", F.substring("word", F.lit(1), depth).alias("node"), _letter("word", depth).alias("ch"), (F.length("word") - depth - 1).alias("rest"), _letter("word", depth + 1).alias("then"))
    one = F.lit(1).cast("bigint")
    shifted = lambda by: F.call_function("shiftleft", one, by)
    return steps.groupBy("depth", "node", "ch").agg(
        F.count("*").alias("passing"), F.bit_or(shifted(F.col("rest"))).alias("rests"), F.bit_or(F.when(F.col("rest") > 0, shifted(_bit(F.col("then")))).otherwise(F.lit(0).cast("bigint"))).alias("nexts"))


def _goes_on(word: str, pos: Column) -> Column:
    """Whether some word of the trie lies below an edge for the letters from pos on, as far as its bits tell."""
    rest = F.length(word) - pos
    has = lambda bits, by: F.call_function("shiftrightunsigned", F.col(bits), by).bitwiseAND(1) == 1
    return (rest >= 0) & has("rests", rest) & ((rest == 0) | has("nexts", _bit(_letter(word, pos))))


def _level(words: DataFrame, states: DataFrame | None, edges: DataFrame, level: int, broadcast: bool) -> DataFrame:
    """States after one level's join: word, pos, node, done."""
    way = F.broadcast if broadcast else lambda x: x
    fresh = words.filter(F.length("word") > level).select("word", F.substring("word", 1, level).alias("node") if level else F.lit("").alias("node"))
    own, after, long = _letter("word", level), _letter("word", level + 1), F.length("word")
    replaced = (F.col("ch") > own) & _goes_on("word", F.lit(level + 1))
    skipped = (((F.col("ch") == after) & (after != own)) | ((F.col("ch") == own) & (long == level + 2))) & (long >= level + 2) & _goes_on("word", F.lit(level + 2))
    met = fresh.join(way(edges), "node").filter(replaced | skipped)
    out = met.select("word", F.explode(F.array_compact(F.array(F.when(replaced, level + 1), F.when(skipped, level + 2)))).alias("pos"), F.concat("node", "ch").alias("node"))
    if states is not None:
        here = states.withColumn("ch", _letter("word", F.col("pos")))
        kept = here.join(way(edges), ["node", "ch"]).filter(_goes_on("word", F.col("pos") + 1))
        out = out.unionByName(kept.select("word", (F.col("pos") + 1).alias("pos"), F.concat("node", "ch").alias("node")))
    return out.withColumn("done", F.col("pos") == F.length("word"))


def _walked(words: DataFrame, scratch: common.Scratch) -> list[DataFrame]:
    """Pairs (word, near) of the trie, a table for each level."""
    spark = words.sparkSession
    short = words.filter(F.length("word") <= LONG).select("word")
    edges = trie_edges(short)
    edges = scratch.staged(edges.repartitionByRange(common.shuffle_partitions(spark), "depth", "node"), "trie-edges")
    n = short.count()
    nodes = edges.groupBy("depth", "node").agg(F.sum("passing").alias("passing"))
    heavy = scratch.staged(nodes.filter(F.col("passing") * HEAVY > n).select("depth", "node"), "trie-heavy")
    with_heavy = {r[0]: r[1] for r in heavy.groupBy("depth").count().collect()}  # a row for each level
    sizes = {r[0]: r[1] for r in nodes.groupBy("depth").count().collect()}
    out, states = [], None
    for level in range(len(sizes)):
        at = edges.filter(F.col("depth") == level).select("node", "ch", "rests", "nexts")
        few = heavy.filter(F.col("depth") == level).select("node")
        parts = []
        if level in with_heavy:
            parts.append(_level(short, states, at.join(F.broadcast(few), "node", "left_semi"), level, True))
        if sizes[level] > with_heavy.get(level, 0):
            light, mine, theirs = at, short, states
            if level in with_heavy:
                light = at.join(F.broadcast(few), "node", "left_anti")
                mine = short.join(F.broadcast(few), F.substring("word", 1, level) == F.col("node"), "left_anti") if level else short
                theirs = states.join(F.broadcast(few), "node", "left_anti") if states is not None else None
            parts.append(_level(mine, theirs, light, level, False))
        made = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        table = scratch.staged(made, f"trie-level-{level}")
        out.append(table.filter("done").select("word", F.col("node").alias("near")))
        states = table.filter("not done").drop("done")
    return out


def _long_pairs(words: DataFrame) -> DataFrame:
    """Pairs with a word of more than LONG letters: one edit leaves one half of the shorter word in place; the distance itself decides."""
    w = words.filter(F.length("word") >= LONG).select("word", F.length("word").alias("len"))
    w = w.select("word", "len", F.explode(F.array(F.col("len"), F.col("len") - 1)).alias("base"))
    half = F.floor(F.col("base") / 2).cast("int")
    first = F.struct(F.lit("first").alias("side"), F.xxhash64(F.substring("word", F.lit(1), half)).alias("key"))
    last = F.struct(F.lit("last").alias("side"), F.xxhash64(F.substring("word", F.col("len") - F.col("base") + half + 1, F.col("base") - half)).alias("key"))
    keyed = w.select("word", "len", "base", F.inline(F.array(first, last)))
    a, b = keyed.filter("len = base"), keyed.select(F.col("word").alias("near"), F.col("len").alias("len2"), "base", "side", "key")
    pairs = a.join(b, ["base", "side", "key"]).filter((F.col("len2") > LONG) & ((F.col("len2") > F.col("len")) | (F.col("word") < F.col("near"))))
    return pairs.filter(F.levenshtein("word", "near", 1) == 1).select("word", "near").distinct()


def near_pairs(words: DataFrame, scratch: common.Scratch) -> DataFrame:
    """word, near: each pair of words (column word, distinct, staged) that one inserted, deleted or replaced code point tells apart, once."""
    pairs = _walked(words, scratch)
    if not words.filter(F.length("word") > LONG).isEmpty():
        pairs.append(_long_pairs(words))
    if not pairs:
        return words.select("word", F.col("word").alias("near")).filter(F.lit(False))
    out = pairs[0]
    for p in pairs[1:]:
        out = out.unionByName(p)
    return out


def _roots(forms: DataFrame) -> DataFrame:
    """word, root from (word, form): forms followed to the last, twice as far each round. Counts grow along a chain, so it ends."""
    at = forms.select("word", F.col("form").alias("root"))
    while True:
        nxt = at.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        joined = common.staged(at.join(nxt, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_w").isNotNull().alias("moved")), "spelling-roots")
        at = joined.select("word", "root")
        if joined.filter("moved").isEmpty():
            return at


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the corpus.

    form: the near word of most occurrences (ties: the smallest in code-point order) if it has at least ratio times as
    many, else null; root: where forms lead in the end, the word itself without one; n_near: near words, 0 if none.
    Null and empty texts add nothing, an empty table gives no rows, repeated rows count again, other columns are not read.
    """
    spark, scratch = docs.sparkSession, common.Scratch(docs.sparkSession)
    words = common.staged(word_counts(docs, id_col, text_col), "spelling-words")
    pairs = near_pairs(words, scratch)
    one, two = words.select(F.col("word"), F.col("n").alias("n1")), words.select(F.col("word").alias("near"), F.col("n").alias("n2"))
    both = pairs.join(one, "word").join(two, "near")
    sides = F.array(F.struct("word", "near", F.col("n2").alias("near_n")), F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n1").alias("near_n")))
    best = both.select(F.inline(sides)).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("best"))
    best = common.staged(best.select("word", "n_near", F.col("best.w").alias("best"), (-F.col("best.m")).alias("best_n")), "spelling-near")
    scratch.clear()
    rows = words.join(best, "word", "left")
    far = F.col("best_n") >= ratio * F.col("n")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(far, F.col("best")).alias("form"), F.when(far, F.col("best_n")).alias("form_n"))
    rows = common.staged(rows, "spelling-forms")
    roots = _roots(rows.filter("form is not null").select("word", "form"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
