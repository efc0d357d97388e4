"""Small texts with every odd case, and plain versions of the operators."""

import random
import re

SCHEMA = "doc_id long, text string, key string, row int, shard int, n long, print string, kept boolean, first int, id int"


def documents(seed=1, n=40):
    """Copies, near copies, repeated lines, passages, nulls, empty and long texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    say = lambda k: " ".join(word() for _ in range(k))
    passage = say(60)
    texts = [None, "", " \n\t", "a", "a b", "x" * 5000, "ab " * 900, "Straße 漢字 😀 " * 30, "a\x00b\x1c c\x85d e"]
    for _ in range(n):
        kind, text = r.randrange(5), say(r.randint(1, 150))
        if kind == 0:
            text += " " + passage + " " + say(5)
        elif kind == 1:
            text = "\n".join([say(8)] * 6 + [text])
        elif kind == 2:
            texts.append(text)
        elif kind == 3:
            words = text.split(" ")
            words[r.randrange(len(words))] = word()
            texts.append(" ".join(words).upper())
        texts.append(text)
    return texts


def frame(spark, texts):
    """The texts with ids, a row twice, a row without an id, and columns that operators use inside."""
    rows = [(i, t, "k", 1, 2, 3, "p", True, 4, 5) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[-1], (None, texts[-1], *rows[0][2:])], SCHEMA)


def plain_words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def licence_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
