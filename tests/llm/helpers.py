"""Tables with the awkward rows that every corpus operator must take."""

from __future__ import annotations

import random

#: Names that operators use inside; input tables may have them too.
CLASHES = ("n", "mark", "id", "row", "component", "label", "ids", "key_id")
SCHEMA = "doc_id bigint, text string, " + ", ".join(f"`{name}` string" for name in CLASHES)


def words(seed: int, count: int) -> list[str]:
    draw = random.Random(seed)
    return ["".join(draw.choices("abcdefghijklmnop", k=draw.randint(2, 7))) for _ in range(count)]


def sentence(seed: int, count: int) -> str:
    return " ".join(words(seed, count))


def edited(text: str, places: list[int]) -> str:
    parts = text.split()
    for place in places:
        parts[place] = f"edit{place}"
    return " ".join(parts)


def corpus() -> list[tuple[int | None, str | None]]:
    """Copies, near copies, shared passages, short, empty, null and very long texts."""
    base, passage = sentence(1, 200), sentence(2, 70)
    rows: list[tuple[int | None, str | None]] = [
        (10, base),
        (11, base.upper()),  # equal after A-Z lower-casing
        (12, edited(base, [5])),
        (13, edited(base, [5, 190])),
        (14, edited(base, list(range(0, 200, 9)))),  # too different
        (20, f"{sentence(3, 60)} {passage} {sentence(4, 60)}"),
        (21, f"{sentence(5, 90)} {passage}"),
        (22, f"{passage} {sentence(6, 30)} {passage}"),
        (30, None),
        (31, ""),
        (32, " \t\n "),
        (33, "two words"),
        (34, "Two  words"),
        (35, "Éa éa"),
        (36, "éa éa"),
        (40, sentence(7, 60_000)),
        (41, "x" * 50_000),
        (50, sentence(8, 120)),
        (50, sentence(8, 120)),  # a repeated row
        (None, base),
        (None, sentence(9, 100)),
        (-3, edited(base, [100])),
    ]
    return rows


def frame(spark, rows):
    """Rows as a table with columns whose names clash."""
    filled = [(*row, *("?" for _ in CLASHES)) for row in rows]
    return spark.createDataFrame(filled, SCHEMA)


def row_set(rows, *names):
    return sorted((tuple(row[name] for name in names) for row in rows), key=str)
