import random

import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty, blank, repeated and very long texts, a null id, and columns whose names the operators use inside."""
    rng = random.Random(5)
    words = ["w%d" % i for i in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = text(120)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t "), (7, text(30)), (7, None), (8, "one"), (9, "one"), (10, text(60_000)), (11, "x" * 300_000), (12, "Zwei Wörter, ein Punkt.\nUnd\nnoch mehr\n\n"), (None, base), (13, text(80)), (13, text(80)),
    ]
    rows.append(rows[6])
    return spark.createDataFrame([(i, t, "en" if i else None, "a", i, i, i, "z", i) for i, t in rows], "doc_id long, text string, lang string, source string, score long, rep long, h long, words string, component_id long").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
