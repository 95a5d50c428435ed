import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, source=lambda d: f"s{d % 3}"):
    """documents from {id: text} or [(id, text)]."""
    rows = texts.items() if isinstance(texts, dict) else texts
    return spark.createDataFrame([(d, t, "en", source(d or 0), len(t or "")) for d, t in rows], SCHEMA)


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def edited(text, seed, edits):
    """The text with so many words replaced."""
    r, w = random.Random(seed), text.split(" ")
    for _ in range(edits):
        w[r.randrange(len(w))] = f"x{r.randrange(10**9)}"
    return " ".join(w)


EDGES = {0: None, 1: "", 2: " \n\t ", 3: "one", 4: "Äé ß 中文 words here", 5: "A b  c\nd\x0be\x0cf",
         6: "\x1cx\x85y z", 7: "same same same same same same", 8: "one"}


@pytest.fixture(scope="session")
def edges():
    return dict(EDGES) | {9: prose(1, 60000), 10: prose(2, 300), 11: prose(2, 300), 12: "a " * 5000}


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
