"""Token counts against the library of the model."""

import random

import numpy as np
import public_tokenizers
import pytest
import samples
import sentencepiece
from conftest import rows

from pipekit.llm import token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(PATH)


def random_texts():
    r = random.Random(5)
    wide = lambda: chr(r.choice([r.randint(32, 0x24F), r.randint(0x4E00, 0x9FFF), r.randint(0x1F300, 0x1FAFF)]))
    for _ in range(500):
        yield "".join(r.choice("abcdefgh THEthe ing'\n\t  .,#@0123▁") for _ in range(r.randint(0, 200)))
        yield "".join(wide() for _ in range(r.randint(0, 80)))
        yield "".join(r.choice("aeinst x-=*_") * r.randint(1, 40) for _ in range(r.randint(0, 60)))
        yield "".join(r.choice(["<s>", "</s>", "<0x41>", "\0", " ", "the", "   ", "\r\n"]) for _ in range(r.randint(0, 40)))


def test_counts(library, counter, monkeypatch):
    texts = [t or "" for t in samples.documents()] + list(random_texts())
    texts += ["x" * 30_000 + " " + "qwertzuiopasdfgh" * 2000, " " * 5000]
    want = [len(ids) for ids in library.encode(texts)]
    assert counter.counts(texts).tolist() == want
    monkeypatch.setattr(token_counts, "LONG", 20)
    assert counter.counts(texts).tolist() == want
    monkeypatch.setattr(token_counts, "MAX_KNOWN", 10)
    assert np.concatenate([counter.counts([t]) for t in texts[:50]]).tolist() == want[:50]


def test_frames(spark, library):
    texts = samples.documents()
    df = samples.frame(spark, texts)
    found = token_counts.token_counts(df, PATH)
    want = [(i, len((t or "").encode()), len(library.encode(t or ""))) for i, t in enumerate(texts)]
    assert rows(found) == [(None, *want[-1][1:]), *want, want[-1]]
    assert token_counts.token_counts(df.limit(0), PATH).count() == 0
