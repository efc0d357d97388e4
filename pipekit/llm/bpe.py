"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

A sequence of tokens is what the merges make of its bytes exactly if that holds for each two
neighbours. A nondeterministic transducer can therefore read bytes, guess where tokens end and drop
the guesses whose last two tokens the merges would not leave side by side; one guess that ends at
the last byte read remains. Its sets of guesses are the states of a deterministic transducer, which
is built for the bytes that are met. A step emits the tokens that all guesses share, so that output
waits for a bounded number of bytes only. The table of states is dropped when it grows too large.

Decoding joins the bytes of the ids and reads them with a state machine for UTF-8 that keeps its state
between calls, so that a `Stream` takes ids in chunks; a broken sequence becomes U+FFFD in `text`.

Defined results: a null or empty text has no tokens; null ids decode like an empty list; an id
without a token is an error; other columns are ignored; equal rows are all returned; an empty table
gives an empty table.
"""

from __future__ import annotations

import base64
import gc
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from pipekit.llm.arrays import chosen, extended, flat, resident, sized_batches

MAX_STATES, MAX_PIECES = 200_000, 600_000
NO_TOKEN, NO_NODE, GUESSES = -1, -1, -1
ID = array("i").itemsize
LONG = 4 * 1024 * 1024  # characters


def load_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a rank file by their bytes."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Transducer:
    """Bytes of one piece of text to token ids.

    A guess is (last token, node of the token begun, tokens not emitted yet); nodes are the
    prefixes of tokens, 0 is the empty one.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.packed = {rank: array("i", [rank]).tobytes() for rank in self.token}
        self.never = max(self.token, default=0) + 1  # above all ranks
        node = {prefix: 0 for token in ranks for prefix in (token[:i] for i in range(len(token) + 1))}
        node = {prefix: i for i, prefix in enumerate(sorted(node))}
        begun = {prefix[:-1] for prefix in node if prefix}
        # Keys count through the first part: numbers that share their low bits would collide in a dict.
        self.width = len(node)
        # By node and byte: the next node, if longer tokens go on there, and the token that ends there.
        self.moves = {
            prefix[-1] * self.width + node[prefix[:-1]]: (i if prefix in begun else NO_NODE, ranks.get(prefix, NO_TOKEN))
            for prefix, i in node.items()
            if prefix
        }
        self.clear()

    def clear(self) -> None:
        # A state is a dict: next state and output by byte; GUESSES has its guesses. States hold each other.
        for state in getattr(self, "states", {}).values():
            state.clear()
        gc.unfreeze()  # what `_encoder` kept from the collector may go
        self.states: dict[tuple, dict] = {}
        self.beside: dict[int, bool] = {}
        self.ends: tuple[dict, dict] = ({}, {})
        guesses = ((NO_TOKEN, 0, b""),)
        self.start = self.states[guesses] = {GUESSES: guesses}

    def spine(self, token: int, right: bool) -> list[tuple[bytes, int]]:
        """The parts at one end of a token while merges make it, and the rank at which each part
        goes into the next one; a merge of lower rank than one before it counts as that one."""
        parts = [bytes([b]) for b in self.token[token]]
        found, reached = [], -1
        while len(parts) > 1:
            pairs = [self.ranks.get(a + b, self.never) for a, b in zip(parts, parts[1:])]
            lowest = min(pairs)
            if lowest == self.never:
                break
            reached = max(reached, lowest)
            at = pairs.index(lowest)
            if at == (len(pairs) - 1 if right else 0):
                found.append((parts[-1 if right else 0], reached))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        # A token that merges don't reach stands next to nothing.
        found = [*found, (parts[0], self.never)] if len(parts) == 1 else []
        self.ends[right][token] = found
        return found

    def follows(self, last: int, token: int) -> bool:
        """Whether the merges leave `token` after `last` (NO_TOKEN: alone) as they are."""
        after = self.ends[False].get(token)
        if after is None:
            after = self.spine(token, False)
        if last < 0 or not after:
            return bool(after)
        before = self.ends[True].get(last) or self.spine(last, True)
        rank, never = self.ranks.get, self.never
        left, right = iter(before), iter(after)
        x, x_goes = next(left)
        y, y_goes = next(right)
        while True:
            # Two parts that meet are merged before either goes; of equal ranks the leftmost is first.
            if x_goes > rank(x + y, never) <= y_goes:
                return False
            if x_goes <= y_goes:
                if x_goes == never:
                    return True
                x, x_goes = next(left)
            else:
                y, y_goes = next(right)

    def step(self, state: dict, byte: int) -> tuple[dict, bytes]:
        moves, beside, guesses, ended = self.moves.get, self.beside, [], None
        first = byte * self.width
        for last, node, out in state[GUESSES]:
            move = moves(first + node)
            if move is None:
                continue
            node, token = move
            if node >= 0:
                guesses.append((last, node, out))
            # The bytes so far are one sequence of tokens: a second guess cannot end here.
            if token >= 0 and ended is None:
                key = token * (self.never + 1) + last
                fits = beside.get(key)
                if fits is None:
                    fits = beside[key] = self.follows(last, token)
                if fits:
                    ended = token, 0, out + self.packed[token]
        if ended is not None:
            guesses.append(ended)
        emitted = guesses[0][2]
        if emitted and len(guesses) > 1:
            shared = min([len(out) for _, _, out in guesses])
            while shared and any([out[:shared] != emitted[:shared] for _, _, out in guesses]):
                shared -= ID
            emitted = emitted[:shared]
        if emitted:
            cut = len(emitted)
            guesses = [(last, node, out[cut:]) for last, node, out in guesses]
        guesses = tuple(guesses)
        if len(beside) >= 2 * MAX_STATES:
            beside.clear()
        if len(self.states) >= MAX_STATES:
            self.clear()
        reached = self.states.get(guesses)
        if reached is None:
            reached = self.states[guesses] = {GUESSES: guesses}
        found = state[byte] = reached, emitted
        return found

    def ids(self, piece: bytes) -> bytes:
        """The token ids, as 32-bit numbers."""
        whole = self.ranks.get(piece)
        if whole is not None:  # a token of its own, whether or not merges reach it
            return self.packed[whole]
        state, out = self.start, []
        for byte in piece:
            found = state.get(byte)
            if found is None:
                found = self.step(state, byte)
            state, emitted = found
            if emitted:
                out.append(emitted)
        out.append(next(rest for _, begun, rest in reversed(state[GUESSES]) if not begun))
        return b"".join(out)

    def encode(self, piece: bytes) -> tuple[int, ...]:
        return tuple(array("i", self.ids(piece)))


class Pieces(dict):
    """Token ids, as bytes of 32-bit numbers, by piece of text; of the pieces met last."""

    def __init__(self, transducer: Transducer):
        self.transducer, self.older = transducer, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.transducer.ids(piece.encode())
        if len(piece) <= 64:
            if len(self) >= MAX_PIECES // 2:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in a row, and how many each piece has; equal pieces are looked up once."""
        coded = pa.array(pieces, pa.large_string()).dictionary_encode()
        codes = coded.indices.to_numpy()
        first = np.flatnonzero(np.diff(np.maximum.accumulate(codes), prepend=-1))  # codes count up as pieces appear
        pieces = [pieces[i] for i in first.tolist()]
        ids = [*map(self.get, pieces)]
        # New ones in order: neighbours go through the same states while these are near.
        for i in sorted((i for i, known in enumerate(ids) if known is None), key=pieces.__getitem__):
            ids[i] = self[pieces[i]]
        data, offsets = flat(pa.array(ids, pa.large_binary()).take(coded.indices))
        return data.view(np.int32), np.diff(offsets) // ID


class Utf8:
    """Incremental UTF-8: `feed` returns the complete characters so far."""

    # For a first byte: how many more follow, and the range of the second.
    CONTINUED = {
        **{b: (1, 0x80, 0xBF) for b in range(0xC2, 0xE0)},
        **{b: (2, 0x80, 0xBF) for b in range(0xE1, 0xF0)},
        0xE0: (2, 0xA0, 0xBF),
        0xED: (2, 0x80, 0x9F),
        **{b: (3, 0x80, 0xBF) for b in range(0xF1, 0xF4)},
        0xF0: (3, 0x90, 0xBF),
        0xF4: (3, 0x80, 0x8F),
    }
    BROKEN = "�".encode()

    def __init__(self):
        self.held, self.missing, self.low, self.high = b"", 0, 0x80, 0xBF

    def feed(self, data: bytes) -> bytes:
        if not self.missing and data.isascii():
            return data
        out = bytearray()
        for byte in data:
            if self.missing:
                if self.low <= byte <= self.high:
                    self.held += bytes([byte])
                    self.missing, self.low, self.high = self.missing - 1, 0x80, 0xBF
                    if not self.missing:
                        out += self.held
                    continue
                out += self.BROKEN
                self.missing = 0
            if byte < 0x80:
                out.append(byte)
            elif byte in self.CONTINUED:
                self.held = bytes([byte])
                self.missing, self.low, self.high = self.CONTINUED[byte]
            else:
                out += self.BROKEN
        return bytes(out)

    def close(self) -> bytes:
        return self.BROKEN if self.missing else b""


class Stream:
    """Ids that come in chunks to text: `feed` gives the characters complete so far, `close` what is left."""

    def __init__(self, decoder: Decoder):
        self.decoder, self.machine = decoder, Utf8()

    def feed(self, ids: np.ndarray) -> bytes:
        return self.machine.feed(self.decoder.bytes(np.asarray(ids, np.int64))[0].tobytes())

    def close(self) -> bytes:
        return self.machine.close()


class Decoder:
    """Ids to bytes, and to text whose broken sequences are replaced."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.tokens = pa.array(tokens, pa.large_binary())
        self.known = np.array([len(t) > 0 for t in tokens], bool)
        self.whole = np.array([self.complete(t) for t in tokens], bool)

    @staticmethod
    def complete(token: bytes) -> bool:
        machine = Utf8()
        return machine.feed(token) + machine.close() == token

    def bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes in a row, and where those of each token end."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.known) or not self.known[ids].all()):
            raise ValueError("an id without a token")
        data, offsets = flat(self.tokens.take(pa.array(ids)))
        return data, offsets[1:]

    def text(self, ids: np.ndarray) -> bytes:
        """UTF-8, from one stream."""
        stream = Stream(self)
        return stream.feed(ids) + stream.close()


def _encoder(path: str, pattern: str):
    """A function from Arrow text columns to columns of ids."""
    pieces = resident(f"pieces {path}", lambda: Pieces(Transducer(load_ranks(path))))
    compiled = regex.compile(pattern)

    def blocks(text: str) -> Iterator[list[str]]:
        if len(text) < LONG:
            yield compiled.findall(text)
            return
        found = (piece[0] for piece in compiled.finditer(text))  # never all pieces of a long text at once
        while block := list(islice(found, LONG // 8)):
            yield block

    def encode(column: pa.Array) -> pa.Array:
        held, counts, done = [], [0], []
        gc.disable()
        try:
            for text in column.to_pylist():
                counts.append(0)
                for block in blocks(text or ""):
                    counts[-1] += len(block)
                    held += block
                    if len(held) >= LONG // 8:
                        done.append(pieces.ids(held))
                        held = []
            done.append(pieces.ids(held))
        finally:
            gc.collect(1)
            gc.freeze()  # or the collector looks through all states again and again
            gc.enable()
        ids, sizes = map(np.concatenate, zip(*done))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        offsets = ends[np.cumsum(counts)].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))

    return encode


def _decoded(decoder: Decoder, ids: pa.Array) -> tuple[pa.Array, pa.Array]:
    """The bytes of each row of ids, and the same as UTF-8.

    Whole characters pass the machine unchanged, so that only the runs of tokens with parts of characters
    are fed to it, token by token, one machine for all runs of the batch; a row is put together anew, by a
    stream of its own, only where what comes out of a run is not what went in.
    """
    sizes = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    values = ids.flatten().to_numpy()
    data, ends = decoder.bytes(values)
    last = np.cumsum(sizes)
    cuts = np.concatenate([[0], ends])
    bounds = cuts[np.concatenate([[0], last])].astype(np.int64)
    found = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).cast(pa.binary())
    parts = np.flatnonzero(~decoder.whole[values])
    row = np.searchsorted(last, parts, side="right")
    ended = np.append((np.diff(parts) > 1) | (np.diff(row) > 0), True)[: len(parts)]
    whole, machine, changed = data.tobytes() if len(parts) else b"", Utf8(), set()
    feed, start, out = machine.feed, None, b""
    for i, a, b, final in zip(row.tolist(), cuts[parts].tolist(), ends[parts].tolist(), ended.tolist()):
        start = a if start is None else start
        out += feed(whole[a:b])
        if final:
            if out + machine.close() != whole[start:b]:
                changed.add(i)
            machine.missing, start, out = 0, None, b""
    if not changed:
        return found, found
    shown, begins = found.to_pylist(), np.concatenate([[0], last])
    for i in changed:
        shown[i] = decoder.text(values[begins[i] : begins[i + 1]])
    return found, pa.array(shown, pa.binary())


def _decoder(path: str) -> Decoder:
    return resident(f"decoder {path}", lambda: Decoder(load_ranks(path)))


def encode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key` and `ids`, the token ids of the text, each match of `pattern` encoded by itself."""
    return _mapped(df, path, pattern, key, text, decoded=False)


def round_trip(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, `ids`, and `decoded`, the UTF-8 that the ids are decoded to, in one pass."""
    return _mapped(df, path, pattern, key, text, decoded=True)


def _mapped(df: DataFrame, path: str, pattern: str, key: str, text: str, decoded: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids, decoder = _encoder(path, pattern), _decoder(path)
        for batch in sized_batches(batches, "text"):
            columns = {"key": batch.column("key"), "ids": to_ids(batch.column("text"))}
            if decoded:
                columns["decoded"] = _decoded(decoder, columns["ids"])[1]
            yield pa.RecordBatch.from_pydict(columns)

    rows = chosen(df, key=key, text=text)
    schema = extended(rows, ["key"], "ids array<int>" + ", decoded binary" * decoded)
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def decode(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """`key`, `decoded`, the bytes of the ids, and `text`, the same as valid UTF-8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(path)
        for batch in batches:
            found, shown = _decoded(decoder, batch.column("ids"))
            columns = [batch.column("key"), found, shown.cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "decoded", "text"])

    rows = chosen(df, key=key, ids=ids)
    rows = rows.withColumn("ids", rows["ids"].cast("array<int>"))
    schema = extended(rows, ["key"], "decoded binary, text string")
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


__all__ = ["Decoder", "Stream", "Transducer", "Utf8", "decode", "encode", "load_ranks", "round_trip"]
