"""Small document tables with the awkward cases that every operator must take."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, size string, row string, sid string, label string"


def _rows():
    rng = random.Random(5)
    vocabulary = [f"w{i}x" for i in range(400)]
    out = [
        (1, None, None, None),
        (2, "", "en", "a"),
        (3, " \n\t ", "en", "a"),
        (4, "one", "en", "b"),
        (4, "one", "en", "b"),
        (5, "mail a.b@x.org, 10.0.0.1 and +1 (555) 123-4567, card 4111 1111 1111 1111", "en", None),
        (6, "İstanbul Straße ΣΑΣ naïve e\u0301 \u00a0 tab\x1cend <|endoftext|> it's 12345", "de", "b"),
        (7, "Licensed under CC BY-NC 4.0. All rights reserved. General Public License", "en", "c"),
        (8, "!!! ... 12 34", "fr", "c"),
        (None, "no id here at all my friend", "en", "c"),
    ]
    for i in range(10, 40):
        lang = ("en", "fr")[i % 2]
        words = [rng.choice(vocabulary[:200] if lang == "en" else vocabulary[200:]) for _ in range(rng.randint(3, 300))]
        out.append((i, " ".join(words), lang, "abc"[i % 3]))
    out.append((40, " ".join(rng.choice(vocabulary) for _ in range(20_000)), "en", "a"))
    base = [rng.choice(vocabulary) for _ in range(120)]
    for i in range(50, 62):
        copy = list(base)
        if i > 54:
            copy[rng.randrange(120)] = "edited"
        out.append((i, " ".join(copy), "en", "a"))
    return [(*r, 7, "clash", "clash", "clash", "clash", "clash") for r in out]


@pytest.fixture(scope="session")
def rows():
    return _rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
