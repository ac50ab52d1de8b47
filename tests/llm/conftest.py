import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_length int"


def _words(rng, n):
    return [rng.choice(["ba", "Co", "du", "fé", "gi", "hol", "ji", "kant", "lo", "mu"]) + rng.choice(["na", "ra", "st", "t", "", "x"]) for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text) with nulls, empty, long, equal, near-equal texts and shared passages."""
    rng = random.Random(5)
    out = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "One  two"), (None, "without id one two three four five")]
    base = [" ".join(_words(rng, 60)) + ". " + " ".join(_words(rng, 60)) + ".\n" + " ".join(_words(rng, 30)) + "." for _ in range(12)]
    passage = " ".join(_words(rng, 25)) + ". " + " ".join(_words(rng, 25)) + ". " + " ".join(_words(rng, 20)) + "."
    for i, t in enumerate(base):
        out.append((10 + i, t))
    for i in range(30):  # near copies of one text
        w = base[0].split(" ")
        w[rng.randrange(len(w))] = f"new{i}"
        out.append((100 + i, " ".join(w)))
    for i in range(5):
        out.append((200 + i, base[1]))
        out.append((300 + i, " ".join(_words(rng, 40)) + ".\n" + passage + "\n" + " ".join(_words(rng, 40)) + "."))
    out.append((400, " ".join(_words(rng, 20_000))))
    out.append((401, "a" * 3000))
    out.append((402, "The LINE that many documents hold \r\n" + "x y z\n" * 3))
    out += [(403 + i, f"  the line THAT many documents hold\nown {i} text\n the line that many documents hold") for i in range(4)]
    out.append((10, base[2]))  # an id that repeats
    return out


@pytest.fixture(scope="session")
def docs(spark, corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus") / "documents.parquet")
    rows = [(d, t, ("en", "fr", None)[i % 3], "s", 0, 0) for i, (d, t) in enumerate(corpus)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
