import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
HARD = [(1, "Alpha beta gamma delta epsilon zeta"), (2, None), (3, ""), (4, "Alpha beta gamma delta epsilon zeta"), (5, "one two"), (6, "ONE two"),
        (7, LONG), (8, LONG + " tail"), (9, "  \n\t "), (5, "one two"), (None, "Alpha beta gamma delta epsilon zeta"), (None, None),
        (10, "line one of several words here\nline two of several words here\nline three of words\n" * 3)]
#: Names that the operators use inside, as extra columns.
EXTRA = "row node component x d n key band body chunks gone host path evidence seed tokens base digest _keep_id"


def table(spark, rows, extra=EXTRA):
    """(doc_id, text) rows with lang, source, n_chars and columns whose names clash with inner ones."""
    names = extra.split()
    kinds = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", `{n}` string" for n in names)
    return spark.createDataFrame([(i, t, "en", "s", None, *["c"] * len(names)) for i, t in rows], kinds)


@pytest.fixture(scope="session")
def hard(spark):
    return table(spark, HARD).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return table(spark, [])


@pytest.fixture(scope="session")
def families():
    """Texts in families of edits at many distances, with exact copies and chains."""
    rng = random.Random(7)
    vocab = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    out = []
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.randint(4, 160))]
        for k in range(rng.randint(1, 9)):
            words = list(base)
            for _ in range(rng.randint(0, k)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            out.append(" ".join(words))
            if rng.random() < 0.2:
                out.append(out[-1])
            if k % 3 == 2:
                base = words
    rng.shuffle(out)
    return list(enumerate(out))
