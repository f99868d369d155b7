from __future__ import annotations

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = "doc_id long, text string, fp long, block long, row string, at int"


def edge_rows(seed: int = 7) -> list[tuple]:
    """Nulls, empty and long texts, ties, repeated rows and ids, shared passages."""
    rng = random.Random(seed)
    word = [f"w{i}" for i in range(400)] + ["é", "ß", "日本", "Zu", "The", "THE"]
    text = lambda n: " ".join(rng.choice(word) for _ in range(n))
    shared, other = text(70), text(45)
    rows = [(i, text(rng.randint(0, 90))) for i in range(20)]
    rows += [(100 + i, f"{text(9)}\n{shared}\t {text(7)}") for i in range(5)]
    rows += [(110 + i, f"{other} {text(12)} {shared}") for i in range(3)]
    base = text(120).split()
    for i in range(6):
        w = list(base)
        w[rng.randrange(120)] = f"edit{i}"
        rows.append((120 + i, " ".join(w)))
    rows += [(130, " ".join(base)), (131, " ".join(base)), (131, " ".join(base)), (131, shared)]
    rows += [(140, None), (141, ""), (142, " \n\t "), (143, "one"), (144, "one"), (145, "one two"), (146, "a " * 300), (147, "ab" * 900), (None, shared), (None, None)]
    rows += [(150, text(4000)), (151, "x" * 5000)]
    return rows


@pytest.fixture(scope="session")
def edge(spark):
    """Edge rows with extra columns whose names clash with the operators' own."""
    rows = edge_rows()
    return spark.createDataFrame([(i, t, 1, 2, "r", 3) for i, t in rows], SCHEMA), rows


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
