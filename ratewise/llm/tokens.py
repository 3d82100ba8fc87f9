"""Token ids of whole texts by the tokenizers library, with a table of the pieces already seen.

White space splits a text into pieces whose ids do not depend on their neighbours, and so does the border between an
ASCII letter and an ASCII sign that the vocabulary always splits from letters; each distinct piece is encoded
once by the library (many in one call, told apart by an added token) and looked up afterwards by its 64-bit hash (pieces with equal hashes would be taken for each other;
among a worker's MOST_PIECES pieces that is less likely than one in ten million). A text with white space outside of ASCII, where a
byte-level vocabulary's pieces could depend on their neighbours, is encoded whole, and so is a text that holds the string of
one of the vocabulary's added tokens (in any case where the library looks for it in the normalised text): the library makes one id of it.
"""

from __future__ import annotations

import json
import os
import re
import string
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ratewise.llm import textbytes

#: Distinct pieces that a worker remembers (about 40 bytes each); beyond, the table starts anew.
MOST_PIECES = 1_000_000
#: Pieces that the library encodes at a time; each takes it about a kilobyte.
_AT_ONCE = 8192
#: Pieces that stand in one string, an added token between them.
_IN_ONE = 32
_LETTER, _SIGN = 1, 2
#: White space outside of ASCII, and ASCII's that does not split pieces.
_WIDE = r"[\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_encoders: dict[tuple[str, bool], "Encoder"] = {}


class Encoder:
    """keeps_space: pieces begin with their white space (byte-level vocabularies); otherwise white space is dropped."""

    def __init__(self, path: str, keeps_space: bool, most_pieces: int = MOST_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keeps_space, self.most_pieces = keeps_space, most_pieces
        added = [t for t in self.tokenizer.get_added_tokens_decoder().values() if t.content.strip()]
        self.literal = [t.content for t in added if not t.normalized]
        odd = ["(?i:" + re.escape(t.content.strip()) + ")" for t in added if t.normalized]
        if keeps_space:
            odd.append(_WIDE)
        self.pattern = "|".join(odd)
        self.between = next((t for t in added if not (t.normalized or t.lstrip or t.rstrip or t.single_word)), None)
        self.kinds = self._kinds()
        normalizer = json.loads(self.tokenizer.to_str())["normalizer"] or {}
        self.lowers = any(n["type"] == "Lowercase" for n in normalizer.get("normalizers", [normalizer]) if n)
        self._forget()

    def _kinds(self) -> np.ndarray:
        """For each byte: a letter, a sign that is split from every letter before and after it, or neither."""
        kinds, letters = np.zeros(256, np.uint8), string.ascii_letters
        split = self.tokenizer.pre_tokenizer
        if split is None:
            return kinds
        kinds[[ord(c) for c in letters]] = _LETTER
        for sign in string.punctuation + string.digits:
            if all([t for _, t in split.pre_tokenize_str(f"{x}{sign}{x}{x}")] == [(0, 1), (1, 2), (2, 4)] for x in letters):
                kinds[ord(sign)] = _SIGN
        return kinds

    def _forget(self) -> None:
        self.ids, self.used = np.empty(1 << 20, np.uint32), 0
        self.hash = np.empty(0, np.uint64)
        self.start, self.length = np.empty(0, np.int64), np.empty(0, np.int32)

    def encode_whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _one_by_one(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        rows = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        lengths = np.fromiter(map(len, rows), np.int32, len(rows))
        return np.fromiter(chain.from_iterable(rows), np.uint32, int(lengths.sum())), lengths

    def _ids_of(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, end to end, and their numbers."""
        if self.between is None:
            return self._one_by_one(pieces)
        joined = [self.between.content.join([*pieces[i : i + _IN_ONE], ""]) for i in range(0, len(pieces), _IN_ONE)]
        flat, _ = self._one_by_one(joined)
        border = flat == self.tokenizer.token_to_id(self.between.content)
        ends = np.flatnonzero(border)
        if len(ends) != len(pieces):  # a piece holds an added token itself
            return self._one_by_one(pieces)
        return flat[~border], np.diff(ends, prepend=-1).astype(np.int32) - 1

    def _learn(self, pieces: list[bytes], hashes: np.ndarray) -> None:
        """hashes: sorted, none of them known."""
        lengths = np.empty(len(pieces), np.int32)
        total = 0
        for i in range(0, len(pieces), _AT_ONCE):
            flat, lengths[i : i + _AT_ONCE] = self._ids_of([p.decode("utf-8") for p in pieces[i : i + _AT_ONCE]])
            while self.used + total + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
            self.ids[self.used + total : self.used + total + len(flat)] = flat
            total += len(flat)
        starts = self.used + np.cumsum(lengths, dtype=np.int64) - lengths
        self.used += total
        at = np.searchsorted(self.hash, hashes)
        self.hash = np.insert(self.hash, at, hashes)
        self.start, self.length = np.insert(self.start, at, starts), np.insert(self.length, at, lengths)

    def _lowered(self, buf: np.ndarray) -> np.ndarray:
        """A-Z in lower case where the vocabulary has it so, but for letters that a mark after them may change first."""
        if not self.lowers:
            return buf
        upper = (buf >= 65) & (buf <= 90)
        upper[:-1] &= buf[1:] < 128
        return np.where(upper, buf + np.uint8(32), buf)

    def _borders(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kinds = self.kinds[buf]
        cut = np.zeros(len(buf) + 1, bool)
        cut[1:-1] = (kinds[1:] ^ kinds[:-1]) == _LETTER ^ _SIGN
        if not self.keeps_space:
            starts, ends = textbytes.words(buf, offsets)
            begin, end = cut, cut.copy()
            begin[starts] = True
            end[ends] = True
            return np.flatnonzero(begin), np.flatnonzero(end)
        gap = (buf == 32) | (buf == 10) | (buf == 9) | (buf == 13)
        cut = cut[:-1]
        cut |= gap
        cut[1:] &= ~(gap[1:] & gap[:-1])
        first = offsets[:-1]
        cut[first[first < len(buf)]] = True
        starts = np.flatnonzero(cut)
        return starts, np.append(starts[1:], len(buf)) if len(starts) else starts

    def _encode_part(self, column: pa.Array) -> list[np.ndarray]:
        buf, offsets = textbytes.buffer_of(column)
        buf = self._lowered(buf)
        starts, ends = self._borders(buf, offsets)
        if len(starts):
            unique, at, inverse = np.unique(textbytes.hashes(buf, starts, ends), return_index=True, return_inverse=True)
        else:
            unique, at, inverse = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        if len(self.hash) + len(unique) > self.most_pieces:
            self._forget()
        place = np.searchsorted(self.hash, unique)
        known = np.zeros(len(unique), bool)
        inside = place < len(self.hash)
        known[inside] = self.hash[place[inside]] == unique[inside]
        if not known.all():
            data, new = buf.tobytes(), np.flatnonzero(~known)
            self._learn([data[a:b] for a, b in zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)], unique[new])
            place = np.searchsorted(self.hash, unique)
        index = place[inverse]
        lengths = self.length[index]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        flat = self.ids[np.repeat(self.start[index] - upto[:-1], lengths) + np.arange(upto[-1])]
        at_text = upto[np.searchsorted(starts, offsets)]
        return [flat[a:b] for a, b in zip(at_text[:-1].tolist(), at_text[1:].tolist(), strict=True)]

    def encode(self, column: pa.Array):
        """Yield the ids of every text of an Arrow string column; a null text has none."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        for a, b in textbytes.parts(column):
            part = column.slice(a, b - a)
            rows = self._encode_part(part)
            if self.literal or self.pattern:
                texts = part.cast(pa.large_string()).fill_null("")
                odd = np.zeros(len(part), bool)
                for string in self.literal:
                    odd |= pc.match_substring(texts, string).to_numpy(zero_copy_only=False)
                if self.pattern:
                    odd |= pc.match_substring_regex(texts, self.pattern).to_numpy(zero_copy_only=False)
                for i in np.flatnonzero(odd).tolist():
                    rows[i] = self.encode_whole(part[i].as_py() or "")
            yield from rows


def encoder(path: str, keeps_space: bool) -> Encoder:
    """This worker's encoder of a vocabulary file; it outlives a task."""
    if (path, keeps_space) not in _encoders:
        _encoders[path, keeps_space] = Encoder(path, keeps_space)
    return _encoders[path, keeps_space]
