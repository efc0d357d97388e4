"""Byte-level BPE against the library that reads the same ranks, and round trips."""

import gc
import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import samples
import tiktoken

from pipekit.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = bpe.load_ranks(PATH)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts():
    r = random.Random(1)
    wide = lambda: chr(r.choice([r.randint(32, 0x24F), r.randint(0x4E00, 0x9FFF), r.randint(0x1F300, 0x1FAFF)]))
    for _ in range(300):
        yield "".join(r.choice("abcdefgh THEthe ing'\n\t  .,#@0123") for _ in range(r.randint(0, 200)))
        yield "".join(wide() for _ in range(r.randint(0, 80)))
        yield "".join(r.choice("aeinst") * r.randint(1, 40) for _ in range(r.randint(0, 60)))


@pytest.mark.parametrize("limit", [150_000, 50])
def test_encode(library, monkeypatch, limit):
    monkeypatch.setattr(bpe, "LONG", limit)
    monkeypatch.setattr(bpe, "MAX_STATES", limit)
    monkeypatch.setattr(bpe, "MAX_PIECES", limit)
    texts = [t or "" for t in samples.documents()] + list(random_texts()) + ["x" * 20_000 + "ab" * 9_000]
    pieces = bpe.Pieces(bpe.Transducer(bpe.load_ranks(PATH)))
    monkeypatch.setattr(bpe, "resident", lambda name, make: pieces)
    found = bpe._encoder(PATH, public_tokenizers.PATTERN)(pa.array(texts)).to_pylist()
    assert found == library.encode_ordinary_batch(texts)


def test_pieces_of_a_batch_are_looked_up_once(library, monkeypatch):
    """Also those too long to be remembered, new ones in order; no state is left to the collector."""
    met = []

    class Counted(bpe.Pieces):
        def __missing__(self, piece):
            met.append(piece)
            return super().__missing__(piece)

    pieces = Counted(bpe.Transducer(bpe.load_ranks(PATH)))
    monkeypatch.setattr(bpe, "resident", lambda name, make: pieces)
    texts = ["zebra " + "qwvx" * 30, None, "", " abc qwvx", "zebra"] * 3
    found = bpe._encoder(PATH, public_tokenizers.PATTERN)(pa.array(texts)).to_pylist()
    assert found == library.encode_ordinary_batch([t or "" for t in texts])
    assert met == [" abc", " qwvx", " " + "qwvx" * 30, "zebra"]
    watched = {id(x) for x in gc.get_objects()}
    assert not any(id(state) in watched for state in pieces.transducer.states.values())
    pieces.transducer.clear()
    assert gc.get_freeze_count() == 0


def test_small_vocabulary_with_ties():
    """Equal merges are applied from the left, and a token that merges don't make is only a whole piece."""
    ranks = {bytes([b]): b for b in range(256)} | {b"aa": 300, b"aaa": 301, b"ab": 302, b"xyz": 303}
    transducer = bpe.Transducer(ranks)

    def merged(text):
        parts = [text[i : i + 1] for i in range(len(text))]
        while True:
            ranked = [ranks.get(a + b, 999) for a, b in zip(parts, parts[1:])]
            if not ranked or min(ranked) == 999:
                return tuple(ranks[p] for p in parts)
            at = ranked.index(min(ranked))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    r = random.Random(0)
    for _ in range(2000):
        text = bytes(r.choice(b"aabxyz") for _ in range(r.randint(1, 12)))
        assert transducer.encode(text) == ((ranks[text],) if text in ranks else merged(text))


def test_decoding_is_incremental():
    r = random.Random(2)
    decoder = bpe.Decoder(bpe.load_ranks(PATH))
    for _ in range(500):
        ids = np.array([r.randrange(50256) if r.random() < 0.3 else r.randrange(256) for _ in range(30)])
        data = decoder.bytes(ids)[0].tobytes()
        assert decoder.text(ids).decode() == data.decode(errors="replace")
        machine = bpe.Utf8()
        parts = [machine.feed(data[i : i + 3]) for i in range(0, len(data), 3)] + [machine.close()]
        assert b"".join(parts).decode() == data.decode(errors="replace")
        assert all(p.decode() is not None for p in parts)  # whole characters only
        # Ids in chunks that cut characters come to the same.
        stream, cut = bpe.Stream(decoder), r.randrange(1, 5)
        chunks = [stream.feed(ids[i : i + cut]) for i in range(0, len(ids), cut)] + [stream.close()]
        assert b"".join(chunks) == decoder.text(ids)
        assert all(chunk.decode() is not None for chunk in chunks)
    with pytest.raises(ValueError, match="without a token"):
        decoder.bytes(np.array([60_000]))


def test_rows_of_a_batch_share_one_machine():
    """Broken and whole runs at the ends of rows and next to each other."""
    r = random.Random(4)
    decoder = bpe.Decoder(bpe.load_ranks(PATH))
    by_byte = {token[0]: rank for token, rank in bpe.load_ranks(PATH).items() if len(token) == 1}
    texts = ["é", "漢字", "🦫🩻", "a"]
    rows = []
    for _ in range(300):
        data = "".join(r.choice(texts) for _ in range(r.randrange(6))).encode()
        data = data[r.randrange(2) : len(data) - r.randrange(2)]
        rows.append([by_byte[b] for b in data])
    found, shown = bpe._decoded(decoder, pa.array(rows, pa.list_(pa.int32())))
    for ids, raw, text in zip(rows, found.to_pylist(), shown.to_pylist()):
        assert raw == b"".join(decoder.bytes(np.array([i]))[0].tobytes() for i in ids)
        assert text.decode() == raw.decode(errors="replace")


def test_frames(spark, library):
    texts = samples.documents()
    df = samples.frame(spark, texts)
    done = bpe.round_trip(df, PATH, public_tokenizers.PATTERN)
    assert done.columns == ["doc_id", "ids", "decoded"]
    for row in done.collect():
        text = texts[-1 if row.doc_id is None else row.doc_id] or ""
        assert row["ids"] == library.encode_ordinary(text) and bytes(row.decoded) == text.encode()
    ids = bpe.encode(df, PATH, public_tokenizers.PATTERN)
    back = {r.doc_id: r.text for r in bpe.decode(ids, PATH).collect()}
    assert back == {None: texts[-1], **{i: t or "" for i, t in enumerate(texts)}}
    odd = spark.createDataFrame([(1, [bpe.load_ranks(PATH)[b"\xc3"]]), (2, None), (3, [])], "doc_id int, ids array<long>")
    assert {r.doc_id: r.text for r in bpe.decode(odd, PATH).collect()} == {1: "�", 2: "", 3: ""}
    assert bpe.round_trip(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_round_trip_decodes_through_the_machine(monkeypatch):
    """What the machine emits is returned, and a character over several tokens reaches it in parts."""
    fed, decoder = [], bpe.Decoder(bpe.load_ranks(PATH))

    class Loud(bpe.Utf8):
        def feed(self, data):
            fed.append(data)
            return super().feed(data).replace("🦫".encode(), b"beaver")

    class Rows:  # runs the function of the tasks in this process
        def mapInArrow(self, run, schema):
            (self.found,) = run([pa.RecordBatch.from_pydict({"key": [*range(5)], "text": ["plain", None, "x 🦫 y", "", "漢字🩻"]})])
            return self

        def withColumnRenamed(self, *names):
            return self.found.to_pydict()

    monkeypatch.setattr(bpe, "Utf8", Loud)
    monkeypatch.setattr(bpe, "_decoder", lambda path: decoder)
    monkeypatch.setattr(bpe, "chosen", lambda df, **columns: Rows())
    monkeypatch.setattr(bpe, "extended", lambda *schema: None)
    found = bpe.round_trip(None, PATH, public_tokenizers.PATTERN)
    assert found["decoded"] == [b"plain", b"", b"x beaver y", b"", "漢字🩻".encode()]
    assert any(len(part.decode(errors="ignore").encode()) < len(part) for part in fed)
