"""Small corpora with the awkward cases in them, for all tests here."""

import random

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """rows: (doc_id, text)."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)


def awkward(seed=0):
    """(doc_id, text): copies, near copies, shared passages, nulls, empties, blanks, one-word and very long texts, odd white space."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 6)))
    line = lambda n=8: " ".join(word() for _ in range(n))
    text = lambda n: "\n".join(line() for _ in range(n))
    base, passage, common = text(20), line(60), line()
    rows = [(100, base), (7, base), (55, base), (3, None), (4, ""), (5, " \t\n "), (6, "word"), (8, "word"), (9, "Word")]
    for i in range(30):  # near copies
        words = base.split(" ")
        for _ in range(3):
            words[rng.randrange(len(words))] = word()
        rows.append((200 + i, " ".join(words)))
    rows += [(300 + i, text(3) + "\n" + passage + "\n" + text(rng.randint(1, 4))) for i in range(12)]
    rows += [(400 + i, common + "\n" + text(rng.randint(2, 6)) + "\n" + common) for i in range(25)]
    rows += [(500 + i, text(rng.randint(1, 8))) for i in range(40)]
    rows += [(600, "\r\n".join(line() for _ in range(5)) + "\x0b\x0c end"), (601, "naïve café über 東京 words"), (602, (line() + " ") * 900), (603, text(1500)), (604, "same " * 300)]
    rng.shuffle(rows)
    return rows


def clashing(docs):
    """The same documents with columns named like intermediate and result columns."""
    for name in ("n_words", "n_removed", "kept", "slice_id", "row", "words", "hits", "items", "rep", "class", "n_lines", "masks", "host", "path", "score", "bands", "z", "id", "ids"):
        docs = docs.withColumn(name, F.lit("clash"))
    return docs
