"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

WORDS = "the of and river stone Haus été année blue green runs über small light tree paper window sky old new".split()


def sentence(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def documents(spark, seed: int = 3):
    """(doc_id, text, source, score, rank): copies, near copies, a shared passage, a hot source, odd rows."""
    r = random.Random(seed)
    rows, passage = [], sentence(r, 70)
    base = [sentence(r, 60) for _ in range(12)]
    for i, text in enumerate(base):
        rows.append((10 + i, text))
    for i in range(12):
        words = base[i].split()
        words[r.randrange(5)] = "changed"
        rows.append((100 + i, " ".join(words)))
    for i in range(6):
        rows.append((200 + i, base[0]))
    for i in range(6):
        rows.append((300 + i, f"{sentence(r, 40)} {passage} {sentence(r, 40)}"))
    rows += [(400, None), (401, ""), (402, "  \n\t "), (403, "one two three"), (404, "one two three"), (405, "x" * 50_000), (406, "ha " * 4000),
             (407, "\u00e9\u00e9 \u4e2d\u6587 \U0001f600 <|endoftext|> \u03a3\u03a3"), (None, base[1]), (None, None), (10, base[0]), (10, base[0]), (11, sentence(r, 30))]
    full = [(i, t, "hot" if n % 3 else "cold", 0.5, n) for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, text string, source string, score double, rank int").repartition(5)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, score double, rank int")


def rows_of(df):
    return [r.asDict() for r in df.collect()]
