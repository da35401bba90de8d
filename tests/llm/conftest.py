import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, node long, size int, `row.x` string"


def words(rng, n):
    return [rng.choice("abcdefghijklmnop") + "".join(rng.choice("aeioustrln") for _ in range(rng.randint(1, 7))) for _ in range(n)]


def corpus(seed=3, n=60):
    """Texts with copies, near copies, shared passages, empties, nulls, one long text, repeated rows and other scripts."""
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        lines = [" ".join(words(rng, rng.randint(1, 14))) for _ in range(rng.randint(1, 9))]
        texts.append(".\n".join(lines))
    passage = " ".join(words(rng, 70))
    for k in range(0, n, 9):
        texts[k] += "\n" + passage
    for k in range(8):  # near copies of one text
        base = " ".join(words(random.Random(5), 120)).split(" ")
        base[10 + k] = "changed"
        texts.append(" ".join(base))
    texts += [texts[3], texts[3] + "  ", texts[3].replace(" ", "\t ", 1), texts[4].upper(), None, "", " \n\t ", "one", "ONE", "two words", "été Ünïcode 中文 \U0001f600", "1234 5678", "!!! ???", "one <|endoftext|> two"]
    texts.append("\n".join(" ".join(words(rng, 12)) for _ in range(1500)))
    rows = [(k, t, ["en", "de", None][k % 3], ["a", "a", "a", "b", None][k % 5], None, "x", 7, 8, "dot") for k, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[3], "en", "a", 1, None, None, None, None), (None, "alone without id", None, "c", None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
