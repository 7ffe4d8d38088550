"""SentencePiece BPE encoding and decoding, exactly as the library does it, by vectorised merge rounds.

All words of a batch that are not known yet lie in one flat array of symbols. A round finds for each
word the pair of least rank (a segmented minimum), merges its occurrences from the left, compacts the
arrays and looks up only pairs next to a merge. Rounds end when no pair is left.

Merging all occurrences at once equals the library's one-by-one order as long as no pair that a merge
creates ranks before the merged one or equal to it; words where one does get only their leftmost merge
in that round.

Defined results: a null or empty text has no ids and decodes to an empty text; characters outside the
vocabulary become byte pieces; ids beyond the vocabulary are an error; rows are never dropped, so equal
rows give equal results; an empty table gives an empty table; other columns than the named ones are
not read, so their names cannot clash.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import limit_batches, slices

#: Fixed values of the model format: the space symbol, piece types, the surface of an unknown piece.
SPACE_SYMBOL = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
UNKNOWN_SURFACE = " ⁇ "

NO_PAIR = np.int64(1 << 40)
#: Words remembered between batches; beyond that the memory starts afresh.
REMEMBERED_WORDS = 300_000


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


class BpeModel:
    """Vocabulary, pair ranks and both directions of a SentencePiece BPE model with byte fallback."""

    def __init__(self, data: bytes):
        top = list(_fields(data))
        self.pieces: list[str] = []
        self.types: list[int] = []
        scores: list[float] = []
        for number, value in top:
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.types.append(piece.get(3, NORMAL))
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
        trainer = dict(_fields(next((v for n, v in top if n == 2), b"")))
        normalizer = dict(_fields(next((v for n, v in top if n == 3), b"")))
        if trainer.get(3, 1) != 2 or not trainer.get(35) or normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(3, 1):
            raise ValueError("only BPE models with byte fallback, a dummy prefix and no normalisation are supported")
        if set(self.types) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("user-defined and unused pieces are not supported")

        ids = {p: i for i, p in enumerate(self.pieces) if self.types[i] == NORMAL}
        if any(c not in ids for p in ids for c in p):
            raise ValueError("each character of a piece must be a piece")
        if any(SPACE_SYMBOL in p.lstrip(SPACE_SYMBOL) for p in ids):
            raise ValueError("pieces may have the space symbol in front only")
        self.size = len(self.pieces)
        self.unknown_char = self.size  # never part of a pair
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.types[i] == BYTE}
        levels = {s: r for r, s in enumerate(sorted({scores[i] for i in ids.values()}, reverse=True))}
        pairs = sorted((ids[p[:k]] * (self.size + 1) + ids[p[k:]], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids)
        self.pair_keys = np.array([k for k, _ in pairs] or [-1], np.int64)
        self.pair_piece = np.array([i for _, i in pairs] or [0], np.int64)
        self.pair_rank = np.array([levels[scores[i]] for _, i in pairs] or [NO_PAIR], np.int64)
        self.char_ids = np.full(0x110000, self.unknown_char, np.int64)
        for p, i in ids.items():
            if len(p) == 1:
                self.char_ids[ord(p)] = i
        # A word starts with space symbols; line ends are words of their own where no piece joins them to others.
        in_pairs = {c for p in ids if len(p) > 1 for c in p}
        ends = "".join(c for c in "\n\r\t" if c not in in_pairs)
        cut = re.escape(ends)
        self.words = re.compile((f"[{cut}]+|" if ends else "") + f"{SPACE_SYMBOL}*[^{SPACE_SYMBOL}{cut}]+|{SPACE_SYMBOL}+")
        self.run = 0
        longest = max((len(p) for p in ids if set(p) == {SPACE_SYMBOL}), default=1)
        if longest > 1 and self._merge([SPACE_SYMBOL * 2 * longest])[0] == np.array([ids[SPACE_SYMBOL * longest]] * 2, np.int32).tobytes():
            self.run = longest  # long runs of spaces split into these from the left

        self.known: dict[str, bytes] = {}  # ids as int32, which take far less room than lists
        surface = [
            {NORMAL: p.replace(SPACE_SYMBOL, " "), UNKNOWN: UNKNOWN_SURFACE, CONTROL: ""}.get(t, "").encode() if t != BYTE else bytes([int(p[3:5], 16)])
            for p, t in zip(self.pieces, self.types, strict=True)
        ]
        self.surface = surface
        self.is_byte = np.array([t == BYTE for t in self.types])
        self.is_control = [t == CONTROL for t in self.types]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair, NO_PAIR if it is none, and the piece that it makes."""
        keys = left * (self.size + 1) + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_rank[at], NO_PAIR), self.pair_piece[at]

    def _merge(self, words: list[str]) -> list[bytes]:
        """Ids of each word (none may be empty), as the bytes of int32 numbers."""
        joined = "".join(words)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.char_ids[points]
        origin = np.arange(len(symbols))  # of unknown characters, for their bytes
        word = np.repeat(np.arange(len(words)), lengths)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        rank, piece = np.full(len(symbols), NO_PAIR), np.zeros(len(symbols), np.int64)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner], piece[inner] = self._ranks(symbols[inner], symbols[inner + 1])
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, starts)
            counts = np.diff(np.r_[starts, len(word)])
            best = np.repeat(best, counts)
            over = best == NO_PAIR
            if over.any():  # words without a pair leave the arrays
                done.append((word[over], symbols[over], origin[over]))
                live = ~over
                symbols, origin, word, rank, piece, best = (x[live] for x in (symbols, origin, word, rank, piece, best))
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == best)
            # Of occurrences that overlap, every second one counts, from the left.
            first = np.flatnonzero(np.r_[True, hit[1:] != hit[:-1] + 1])
            nth = np.arange(len(hit)) - np.repeat(first, np.diff(np.r_[first, len(hit)]))
            hit = hit[nth % 2 == 0]
            made = piece[hit]
            # Pairs that these merges would create, with neighbours as the library's order meets them.
            padded, words_at = np.append(symbols, [self.unknown_char] * 3), np.append(word, [-1] * 3)
            after = np.where(words_at[hit + 2] == word[hit], self._ranks(made, padded[hit + 2])[0], NO_PAIR)
            left = np.where(hit > 0, symbols[hit - 1], self.unknown_char)
            joined_left = np.r_[False, hit[1:] == hit[:-1] + 2]
            left[joined_left] = made[np.flatnonzero(joined_left) - 1]
            same = (hit > 0) & (word[hit - 1] == word[hit])
            before = np.where(same, self._ranks(left, made)[0], NO_PAIR)
            clash = (after <= best[hit]) | (before <= best[hit])
            if clash.any():
                bad = np.zeros(int(word[-1]) + 1, bool)
                bad[word[hit[clash]]] = True
                leftmost = np.r_[True, word[hit[1:]] != word[hit[:-1]]]
                stay = leftmost | ~bad[word[hit]]
                hit, made = hit[stay], made[stay]
            symbols[hit] = made
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            place = np.cumsum(keep) - 1
            symbols, origin, word, rank, piece = (x[keep] for x in (symbols, origin, word, rank, piece))
            # Only pairs on either side of a merged symbol are new.
            beside = np.zeros(len(symbols) + 1, bool)
            beside[place[hit]] = beside[place[hit] - 1] = True
            new = np.flatnonzero(beside[:-1])
            rank[new] = NO_PAIR
            new = new[new + 1 < len(symbols)]
            new = new[word[new] == word[new + 1]]
            rank[new], piece[new] = self._ranks(symbols[new], symbols[new + 1])

        words_of = np.concatenate([x[0] for x in done])
        order = np.argsort(words_of, kind="stable")
        ids = np.concatenate([x[1] for x in done])[order]
        origins = np.concatenate([x[2] for x in done])[order]
        ends = np.cumsum(np.bincount(words_of, minlength=len(words))).tolist()
        raw, unknown = ids.astype(np.int32).tobytes(), self.unknown_char
        out, at = [], 0
        odd = np.zeros(len(words), bool)
        odd[words_of[order][ids == unknown]] = True
        for end, has_unknown in zip(ends, odd.tolist(), strict=True):
            own = raw[4 * at : 4 * end]
            if has_unknown:
                own = np.fromiter(
                    chain.from_iterable([self.byte_ids[b] for b in joined[origins[k]].encode("utf-8", "replace")] if ids[k] == unknown else (ids[k],) for k in range(at, end)), np.int32
                ).tobytes()
            out.append(own)
            at = end
        return out

    def _split(self, text: str) -> list[str]:
        found = self.words.findall(SPACE_SYMBOL + text.replace(" ", SPACE_SYMBOL)) if text else []
        if self.run and SPACE_SYMBOL * (self.run + 1) in "".join(found[:1]) + text.replace(" ", SPACE_SYMBOL):
            run, out = SPACE_SYMBOL * self.run, []
            for w in found:
                spaces = len(w) - len(w.lstrip(SPACE_SYMBOL))
                cut = (spaces - 1) // self.run if spaces else 0
                out += [run] * cut + [w[cut * self.run :]]
            found = out
        return found

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, without begin or end ids."""
        split = [self._split(t) for t in texts]
        new = [w for w in dict.fromkeys(chain.from_iterable(split)) if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED_WORDS:
            self.known.clear()
            new = list(dict.fromkeys(chain.from_iterable(split)))
        if new:
            self.known.update(zip(new, self._merge(new), strict=True))
        known = self.known
        return [np.frombuffer(b"".join([known[w] for w in own]), np.int32) for own in split]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: byte pieces form UTF-8, a broken byte becomes U+FFFD, the dummy prefix goes."""
        if ids and (min(ids) < 0 or max(ids) >= self.size):
            raise ValueError("an id is not in the vocabulary")
        surface = self.surface
        at = next((k for k, i in enumerate(ids) if not self.is_control[i]), 0)
        data = b"".join([surface[i] for i in ids])
        if ids and self.types[ids[at]] == NORMAL and data[:1] == b" ":
            data = data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:
            return _repaired(data)


def _repaired(data: bytes) -> str:
    """data as text, with one U+FFFD for each byte that is in no valid character."""
    out = []
    while data:
        try:
            out.append(data.decode())
            break
        except UnicodeDecodeError as e:
            out.append(data[: e.start].decode() + "�")
            data = data[e.start + 1 :]
    return "".join(out)


_models: dict[int, BpeModel] = {}


def _model(data: bytes) -> BpeModel:
    """One model for each Python worker."""
    key = hash(data)
    if key not in _models:
        _models.clear()
        _models[key] = BpeModel(data)
    return _models[key]


def transcode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) of each row: its text encoded, and those ids decoded again.

    model is the content of the model file (its size is fixed, so it travels with the task)."""
    limit_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _model(shipped.value)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = bpe.encode([t or "" for t in part.column("text").to_pylist()])
                ends = pa.array(np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32))
                decoded = pa.array([bpe.decode(x.tolist()) for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids))), decoded], ["id", "ids", "decoded"])

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)
