import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size string, `key` int, node string, _row int, copies string"
ALPHABET = ["the", "of", "and", "a", "to", "in", "is", "that", "was", "for", "wer", "ling", "sotu", "maber", "quin", "tolva", "erst", "onder"]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(ALPHABET) + r.choice(["", "", "s", "en", "ly"]) for _ in range(n)) + "."


def edge_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, columns whose names clash."""
    long = prose(1, 20_000)
    texts = [None, "", " \n\t ", "word", "two words", prose(2, 120), prose(2, 120), prose(2, 119), prose(3, 300), long, "á ▁ é\U0001f600 x", "line one\n" * 60, prose(4, 80) + "\nReleased under the MIT License.\nmail me: jo.do@mail.example.com +1 (743) 555-3824"]
    rows = [(i, t, ["en", "fr", None][i % 3], ["s1", "s2", None][i % 3], None if t is None else len(t), 0.5, "x", 7, "n", 1, "c") for i, t in enumerate(texts)]
    rows += [rows[5], (None, prose(5, 60), "en", "s1", None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
