"""Small fixtures with the awkward rows that every operator must take."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, alphabet="abcdefgh"):
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(2, 6))) for _ in range(n)]


def family(rng, n, size, edits):
    """``n`` near copies of one text: each has ``edits`` words replaced."""
    base = words(rng, size)
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(edits):
            w[rng.randrange(size)] = "".join(rng.choice("xyz") for _ in range(5))
        out.append(" ".join(w))
    return out


def awkward(spark):
    """Nulls in every column, empty, blank, one-word, very long and repeated texts, repeated rows and ids."""
    long = " ".join(f"w{i % 997}" for i in range(30_000))
    rows = [
        (1, None, "en", "s", None), (2, "", None, None, 0), (3, " \n\t ", "de", "s", 4), (4, "word", "en", None, 4), (5, long, "en", "s", len(long)), (6, long, None, "s", len(long)),
        (7, "same words here for all of us", "en", "s", 29), (7, "same words here for all of us", "en", "s", 29), (8, "same words here for all of us", "en", "s", 29), (9, "a" * 50_000, "en", "s", 50_000),
        (None, "same words here for all of us", "en", "s", 29), (10, "été 😀 naïve ☃ ß", "fr", "s", 15),
    ]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def documents(texts, lang="en", source="s"):
    return [(i, t, lang, source, len(t)) for i, t in enumerate(texts)]


def rng(seed=1):
    return random.Random(seed)
