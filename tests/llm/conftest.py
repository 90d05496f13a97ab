import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, node long, size long, w string, ord long, words_ string, class string"
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards brew strange potions near the silent river bank tonight"


def near(text, every=17):
    """A copy with a few words changed."""
    return " ".join("changed" if i % every == every - 1 else w for i, w in enumerate(text.split(" ")))


def long_text(n, seed=1):
    """Words that hardly repeat."""
    return " ".join(f"w{(i * 7919 + seed * 104729) % 1000003:x}" for i in range(n))


TEXTS = [
    (1, PROSE), (2, PROSE), (3, None), (4, ""), (5, "   \n\t "), (None, "null id text " + long_text(60, 9)), (7, long_text(300)), (8, near(long_text(300), 90)),
    (9, long_text(30_000, 3)), (10, "é" * 40 + " naïve ünïcode 漢字 " + long_text(80, 4)), (11, "one\ntwo lines here\none\n\nthree"), (12, "a a a a a a a a a a"),
    (12, "a a a a a a a a a a"), (13, long_text(300)), (14, "you are a stupid loser and a moron, an idiot. " + long_text(60, 5)), (15, "x" * 5000),
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    rows = [(i, t, "en", s, len(t or ""), "k", 1, 2, "w", 3, "x", "c") for n, (i, t) in enumerate(TEXTS) for s in [["a", "b", None][n % 3]]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
