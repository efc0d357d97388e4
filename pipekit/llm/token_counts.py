"""Token counts of a merge-based piece model, by merging ragged arrays rank by rank.

Texts are normalised by the model's library and cut where no piece can lie across: before a space
mark that follows something else. New pre-tokens of a batch are laid into one array of symbols and
cut further between characters that no piece holds side by side. A round finds the lowest rank among
the neighbouring symbols of each sequence and merges it in all sequences at once; sequences without
a pair in the vocabulary leave, and the symbols they have left are counted, a character outside the
vocabulary as its UTF-8 bytes. Within a sequence all places of the lowest rank are merged in one
round, unless the merged piece could then take part in a merge that goes first; then only the
leftmost is.

Defined results: a null or empty text has no tokens; equal rows are all returned; an empty table
gives an empty table; columns not asked for are ignored. Only models with byte pieces are taken.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from pipekit.llm.arrays import chosen, extended, flat, resident, sized_batches

MARK = "▁"  # what the library makes of a space
NEVER = np.int32(2**31 - 1)
MAX_KNOWN = 400_000  # counts of pre-tokens that are remembered
LONG = 4 * 1024 * 1024  # characters that are cut into pre-tokens at once
WORD_START = re.compile(f"(?<=[^{MARK}]){MARK}")
RUNS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class PieceModel:
    """The vocabulary as sorted arrays: characters, pairs with their rank, and pairs of characters."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib, size = self.library, self.library.vocab_size()
        if not any(lib.is_byte(i) for i in range(size)):
            raise ValueError("the model has no byte pieces")
        own = [i for i in range(size) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i))]
        if any(lib.is_unused(i) for i in own):
            raise ValueError("the model has unused pieces")
        number = {lib.id_to_piece(i): n for n, i in enumerate(own)}
        score = np.array([lib.get_score(i) for i in own])
        rank = np.unique(-score, return_inverse=True)[1]
        if any(MARK in piece.lstrip(MARK) for piece in number):
            raise ValueError("a piece goes on after the end of a word")
        chars = sorted((ord(piece), n) for piece, n in number.items() if len(piece) == 1)
        self.char, self.char_number = (np.array(x, np.int64) for x in zip(*chars))
        pairs, beside = {}, set()
        late = np.zeros(len(number), bool)
        for piece, n in number.items():
            beside.update(ord(a) << 21 | ord(b) for a, b in zip(piece, piece[1:]))
            for cut in range(1, len(piece)):
                left, right = number.get(piece[:cut]), number.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left * len(number) + right] = n
                    for part in (left, right):
                        late[part] |= rank[n] <= rank[part]
        self.size, self.late = len(number), late
        self.beside = np.array(sorted(beside), np.int64)
        self.pair = np.array(sorted(pairs), np.int64)
        self.pair_makes = np.array([pairs[p] for p in self.pair.tolist()], np.int64)
        self.pair_rank = rank[self.pair_makes].astype(np.int32)

    def ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of merging each two symbols; NEVER if that is no piece."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        known = (self.pair[at] == key) & (left >= 0) & (right >= 0)
        return np.where(known, self.pair_rank[at], NEVER), self.pair_makes[at]

    def counts(self, words: list[str]) -> np.ndarray:
        """The tokens of each pre-token."""
        out = np.zeros(len(words), np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        if not len(code):
            return out
        word = np.repeat(np.arange(len(words)), sizes)
        at = np.minimum(np.searchsorted(self.char, code), len(self.char) - 1)
        known = self.char[at] == code
        symbol = np.where(known, self.char_number[at], -1)
        length = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
        np.add.at(out, word[~known], length[~known])
        # Sequences: runs of known characters that pieces hold side by side, within a word.
        close = np.zeros(len(code), bool)
        joint = code[:-1] << 21 | code[1:]
        spot = np.minimum(np.searchsorted(self.beside, joint), len(self.beside) - 1)
        close[1:] = (self.beside[spot] == joint) & (word[1:] == word[:-1]) & known[1:] & known[:-1]
        symbol, word, close = symbol[known], word[known], close[known]
        sequence = np.cumsum(~close) - 1
        owner = word[~close]
        rank, makes = self.pairs_of(symbol, sequence)
        while len(symbol):
            starts = np.flatnonzero(np.concatenate([[True], sequence[1:] != sequence[:-1]]))
            sizes = np.diff(np.concatenate([starts, [len(symbol)]]))
            lowest = np.minimum.reduceat(rank, starts)
            left = lowest < NEVER
            np.add.at(out, owner[sequence[starts[~left]]], sizes[~left])
            stays = np.repeat(left, sizes)
            low = np.repeat(lowest, sizes)[stays]
            symbol, sequence, rank, makes = symbol[stays], sequence[stays], rank[stays], makes[stays]
            hit = np.flatnonzero(rank == low)
            if not len(hit):
                break
            # Of places that overlap, every second one; of late pieces the first of the sequence.
            new_run = np.concatenate([[True], hit[1:] != hit[:-1] + 1])
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(hit)), 0))
            taken = (np.arange(len(hit)) - run_start) % 2 == 0
            first = np.concatenate([[True], sequence[hit[1:]] != sequence[hit[:-1]]])
            taken &= first | ~self.late[makes[hit]]
            hit = hit[taken]
            symbol[hit] = makes[hit]
            keep = np.ones(len(symbol), bool)
            keep[hit + 1] = False
            moved = np.cumsum(keep) - 1
            symbol, sequence, rank, makes = symbol[keep], sequence[keep], rank[keep], makes[keep]
            here = moved[hit]
            changed = np.unique(np.concatenate([here, here[here > 0] - 1]))
            rank[changed], makes[changed] = self.pairs_at(symbol, sequence, changed)
        return out

    def pairs_at(self, symbol: np.ndarray, sequence: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        after = np.minimum(at + 1, len(symbol) - 1)
        rank, makes = self.ranked(symbol[at], symbol[after])
        rank[(after == at) | (sequence[after] != sequence[at])] = NEVER
        return rank, makes

    def pairs_of(self, symbol: np.ndarray, sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.pairs_at(symbol, sequence, np.arange(len(symbol)))


class Counter:
    """Tokens of texts; remembers the pre-tokens met."""

    def __init__(self, path: str):
        self.model = PieceModel(path)
        self.known: dict[str, int] = {}

    def counts(self, texts: list[str | None]) -> np.ndarray:
        normal = self.model.library.normalize
        out = np.zeros(len(texts), np.int64)
        part: list[list[str]] = []  # pre-tokens, and whose they are
        of: list[int] = []
        for i, text in enumerate(texts):
            for piece in _pieces(normal(text)) if text else ():
                words = piece.split(MARK)
                if words[0]:  # no mark before the first word
                    out[i] += self.model.counts(words[:1])[0]
                # Elsewhere a word stands for itself and its mark; several marks in a row are kept.
                part.append(RUNS.findall(MARK + MARK.join(words[1:])) if "" in words[1:] else words[1:])
                of.append(i)
                if len(piece) >= LONG:
                    self._add(out, part, of)
                    part, of = [], []
        self._add(out, part, of)
        return out

    def _add(self, out: np.ndarray, cut: list[list[str]], of: list[int]) -> None:
        new = list(set().union(*cut) - self.known.keys())
        if len(self.known) + len(new) > MAX_KNOWN:
            self.known.clear()
            new = list(set().union(*cut))
        if new:
            marked = [w if w.startswith(MARK) else MARK + w for w in new]
            self.known.update(zip(new, self.model.counts(marked).tolist()))
        known = self.known.__getitem__
        np.add.at(out, of, np.fromiter((sum(map(known, words)) for words in cut), np.int64, len(cut)))


def _pieces(text: str) -> Iterator[str]:
    """A normalised text in pieces of about LONG characters, cut before a word's first mark."""
    start = 0
    while len(text) - start > LONG and (found := WORD_START.search(text, start + LONG)):
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def token_counts(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, `n_bytes` (UTF-8) and `n_tokens` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = resident(f"counter {path}", lambda: Counter(path))
        for batch in sized_batches(batches, "text"):
            column = batch.column("text")
            n_tokens = counter.counts(column.to_pylist())
            columns = [batch.column("key"), pa.array(np.diff(flat(column)[1])), pa.array(n_tokens)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n_bytes", "n_tokens"])

    rows = chosen(df, key=key, text=text)
    return rows.mapInArrow(run, extended(rows, ["key"], "n_bytes long, n_tokens long")).withColumnRenamed("key", key)


__all__ = ["Counter", "PieceModel", "token_counts"]
