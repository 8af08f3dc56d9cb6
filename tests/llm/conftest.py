import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, g int, key string, score string"


def row(i, text, lang="en", source="s"):
    return (i, text, lang, source, None if text is None else len(text), "x", 7, None, "clash")


@pytest.fixture(scope="session")
def corpus():
    """Texts with shared passages, copies, near copies, ties, nulls, empty and long texts, and repeated rows."""
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdeéßü") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passages = [say(n) for n in (34, 35, 36, 60, 90)]
    rows = []
    for i in range(60):
        text = say(rng.randint(0, 50)) + "\n" + rng.choice(passages) + " " + say(rng.randint(0, 30))
        rows.append(row(i, text, rng.choice(["en", "de", None]), rng.choice(["a", "b", None])))
    base = say(120).split(" ")
    for i in range(60, 80):  # near copies
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append(row(i, " ".join(words)))
    rows += [row(80, None), row(81, ""), row(82, " \t\n"), row(83, "One two"), row(84, "one  TWO"), row(85, rows[3][1]),
             row(86, "x " * 3000), row(87, say(6000)), row(88, "y" * 20000), row(None, rows[4][1]), row(None, None),
             row(89, passages[4]), row(89, passages[4]), row(90, "🙂é" * 40), row(91, "é" + "🙂é" * 40)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
