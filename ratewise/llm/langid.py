"""Language ID by a blended-spectrum string kernel.

k(x, y) = n-grams of 1 to 4 bytes that both texts have, over the geometric mean of their own numbers: presence, not
counts. N-grams are hashed to BITS places. Landmarks from every language give a Nyström map of the kernel; in it, ridge
regression of one language against the rest is solved in closed form. Scoring multiplies a batch of presence rows with
the landmarks' rows and the result with the languages' weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewise.llm import common, textbytes

BITS = 1 << 14
#: Labelled rows that a fit uses, about; drawn by a hash of the id, evenly over the languages.
MOST_TRAINING_ROWS = 3000
#: Landmarks of a fit, about; shared evenly by the languages.
LANDMARKS = 192
_ROWS = 128  # scored at a time
_LETTER = r"\p{L}"


def presence(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of BITS flags for each text: which 1- to 4-grams of its bytes occur, ASCII lower-cased, other ASCII as spaces."""
    table = np.arange(256, dtype=np.uint8)
    table[:128] = 32
    for c in range(26):
        table[65 + c] = table[97 + c] = 97 + c
    x = table[buf].astype(np.uint32)
    out = np.zeros((len(offsets) - 1, BITS), bool)
    grams = [x]
    for _ in range(3):
        last = grams[-1]
        grams.append((last[:-1] << np.uint32(8)) | x[len(x) - len(last) + 1 :] if len(last) > 1 else np.empty(0, np.uint32))
    places = [((g + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)) >> np.uint32(18) for n, g in enumerate(grams)]
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        for n, p in enumerate(places):
            out[i, p[a : max(a, b - n)]] = True
    return out


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    landmarks: np.ndarray  # float32, one column for each landmark, divided by the root of its n-grams
    weights: np.ndarray  # landmarks + 1 by languages

    def scores(self, rows: np.ndarray) -> np.ndarray:
        norms = np.sqrt(np.maximum(rows.sum(1), 1))[:, None]
        k = rows.astype(np.float32) @ self.landmarks / norms
        return k @ self.weights[:-1] + self.weights[-1]


def solve(rows: np.ndarray, labels: np.ndarray, languages: list[str], landmarks: int = LANDMARKS, ridge: float = 1e-2) -> Model:
    """Nyström features of the presence rows on landmarks from every language; ridge regression of each language against the rest."""
    each = max(1, landmarks // max(1, len(languages)))
    chosen = np.concatenate([np.flatnonzero(labels == i)[:each] for i in range(len(languages))])
    marks = rows[chosen].astype(np.float32)
    marks /= np.sqrt(np.maximum(marks.sum(1), 1))[:, None]
    k = np.concatenate([rows[i : i + 256].astype(np.float32) @ marks.T / np.sqrt(np.maximum(rows[i : i + 256].sum(1), 1))[:, None] for i in range(0, len(rows), 256)]).astype(float)
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(float))
    good = values > 1e-6 * values[-1]
    nystroem = vectors[:, good] / np.sqrt(values[good])
    features = k @ nystroem
    centre = features.mean(0)
    targets = np.where(labels[:, None] == np.arange(len(languages)), 1.0, -1.0)
    middle = targets.mean(0)
    z = features - centre
    w = np.linalg.solve(z.T @ z + ridge * len(z) * np.eye(z.shape[1]), z.T @ (targets - middle))
    return Model(tuple(languages), np.ascontiguousarray(marks.T), np.vstack([nystroem @ w, middle - centre @ w]))


def _packed(batches):
    for batch in batches:
        for a, b in textbytes.parts(batch.column(1), 1 << 20):
            for c in range(a, b, _ROWS):
                part = batch.slice(c, min(b, c + _ROWS) - c)
                bits = np.packbits(presence(*textbytes.buffer_of(part.column(1))), axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in bits], pa.binary())], names=["lang", "bits"])


def learns_from(doc_id):
    """False for the held-out quarter of ids."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 != 2


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_rows: int = MOST_TRAINING_ROWS, landmarks: int = LANDMARKS) -> Model | None:
    """Fit on labelled rows outside of the held-out quarter, about most_rows of them, evenly over the languages; None without any."""
    labelled = docs.filter(docs[lang_col].isNotNull() & docs[text_col].isNotNull() & learns_from(docs[id_col]))
    found = {r[0]: r[1] for r in labelled.groupBy(labelled[lang_col]).count().collect()}  # one row for each language
    if not found:
        return None
    quota = max(1, most_rows // len(found))
    share = F.create_map(*[x for k, n in found.items() for x in (F.lit(k), F.lit(min(1.0, quota / n)))])
    drawn = labelled.filter(common.seeded_unit(3, labelled[id_col]) < share[labelled[lang_col]])
    rows = common.in_arrow(drawn.select(drawn[lang_col].alias("lang"), drawn[text_col].alias("text")), _packed, "lang string, bits binary").collect()  # about most_rows rows of BITS / 8 bytes
    rows.sort(key=lambda r: (r["lang"], bytes(r["bits"])))
    languages = sorted({r["lang"] for r in rows})
    if not rows:
        return None
    order = np.random.default_rng(5).permutation(len(rows))
    bits = np.unpackbits(np.stack([np.frombuffer(rows[i]["bits"], np.uint8) for i in order]), axis=1).astype(bool)
    return solve(bits, np.array([languages.index(rows[i]["lang"]) for i in order]), languages, landmarks)


def _guesser(model: Model | None, spark):
    """A column function: struct(lang_pred, score) of a text."""
    shared = spark.sparkContext.broadcast(model)  # landmarks by BITS: a fixed size

    @F.arrow_udf("lang_pred string, score double")
    def guess(column: pa.Array) -> pa.Array:
        model = shared.value
        names, scores = np.full(len(column), "und", object), np.zeros(len(column))
        if model is not None:
            lettered = pc.fill_null(pc.match_substring_regex(column, _LETTER), False).to_numpy(zero_copy_only=False)
            for a, b in textbytes.parts(column):
                for c in range(a, b, _ROWS):
                    d = min(b, c + _ROWS)
                    value = model.scores(presence(*textbytes.buffer_of(column.slice(c, d - c))))
                    p = np.exp(3 * (value - value.max(1, keepdims=True)))
                    best = value.argmax(1)
                    names[c:d] = np.array(model.languages, object)[best]
                    scores[c:d] = p[np.arange(len(best)), best] / p.sum(1)
            names[~lettered], scores[~lettered] = "und", 0.0
            pa.default_memory_pool().release_unused()  # a worker outlives its tasks
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores)], ["lang_pred", "score"])

    return guess


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (0 to 1: a softmax of the languages' regression values).

    'und' with score 0 where the text is null or has no letter, or where there was nothing to learn from.
    """
    guess = _guesser(model, docs.sparkSession)
    return docs.withColumn("_guess", guess(docs[text_col])).select("*", "_guess.lang_pred", "_guess.score").drop("_guess")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from docs and predict every row: doc_id, held_out, lang_pred, score. Repeated rows are predicted each; an empty table gives an empty result."""
    model = fit(docs, id_col, text_col, lang_col)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), (~learns_from(docs[id_col])).alias("held_out"))
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def with_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without the documents in no language, and with the predicted language where lang is null; other columns stay as they are.

    In no language are texts that are null or have no letter, whatever could be learnt. Without anything to learn from, null languages stay.
    """
    model = fit(docs, id_col, text_col, lang_col)
    lettered = docs.filter(F.rlike(F.coalesce(docs[text_col], F.lit("")), F.lit(_LETTER)))
    if model is None:
        return lettered
    guessed = _guesser(model, docs.sparkSession)(lettered[text_col])["lang_pred"]
    return lettered.withColumn(lang_col, F.coalesce(lettered[lang_col], guessed))
