"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing names."""

from __future__ import annotations

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "n long, node string, part string, kept string, word string, total long, score string, band string")
CLASHING = (7, "x", "y", "z", "w", 9, "s", "b")


def words(seed: int, count: int, names: int = 60) -> str:
    pick = random.Random(seed)
    return " ".join(f"w{pick.randrange(names)}x" for _ in range(count))


def rows() -> list[tuple]:
    base = words(1, 80)
    texts = [
        (0, base), (1, base), (2, base + " tail"), (2, base + " tail"), (3, None), (4, ""), (5, " \t\n \x0b"),
        (6, "one"), (7, "One"), (8, "a b c d"), (None, words(2, 50)), (None, None), (9, words(3, 4000)),
        (10, words(4, 30)), (10, words(5, 30)), (11, "é ü\nß\n\nß\nß\n" + words(6, 20)), (12, "spam " * 300),
        (13, words(7, 300, 5)), (14, "#$% *** &&& || <>" * 20), (15, "mail x1.y@z.example.org or +1 (988) 555-2485"),
    ]
    out = []
    for k, (doc_id, text) in enumerate(texts):
        out.append((doc_id, text, [None, "en", "de"][k % 3], [None, "s", "", "t"][k % 4],
                    None if text is None else len(text), *CLASHING))
    return out


def edge(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3, "text")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
