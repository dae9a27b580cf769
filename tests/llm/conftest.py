import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, `_row` int, size int, `key` int, part int"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table with extra columns whose names clash with working columns."""
    def docs(rows):
        return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "x", 1, 2, 3, 4) for i, t, s in rows], DOCS)
    return docs


@pytest.fixture(scope="session")
def corpus():
    """Prose, near and exact copies, nulls, empties, repeated rows, a null id and a long text."""
    rnd = random.Random(3)
    words = ["".join(rnd.choice("aeioubcdlmnrst") for _ in range(rnd.randint(1, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    rows = []
    for i in range(60):
        text = "\n".join(prose(rnd.randint(3, 40)) for _ in range(rnd.randint(1, 5)))
        rows.append((i, text, rnd.choice(["b", "a", "é", None])))
    base = prose(150)
    for i in range(60, 90):
        w = base.split(" ")
        for _ in range(rnd.randint(0, 2)):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        rows.append((i, " ".join(w) + "\n" + prose(4), "a"))
    rows += [(100, None, "a"), (101, "", None), (102, " \n\t ", "b"), (103, "one", "b"), (104, "one two", "b"), (None, base, "a"), (None, None, None),
             (105, prose(6000), "b"), (106, "Ünï  cödé \ntab\t x", "é"), (60, rows[60][1], "a"), (60, rows[60][1], "a"), (7, "other text of a known id", "a")]
    return rows
