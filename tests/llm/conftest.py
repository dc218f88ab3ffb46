import random

import pytest

#: Names that operators use inside, as extra columns of the input.
CLASHES = ["size", "score", "node", "votes", "mix_size", "mix_row", "length", "bucket", "langid_text", "rules_text", "classifier_text", "secrets_text", "secret_spans", "clean_text", "quality_score", "kept", "region", "pivot", "shard", "id_", "row_hash"]


@pytest.fixture(scope="session")
def documents(spark):
    """documents(rows): rows of (doc_id, text, lang, source), with extra columns whose names clash."""

    def make(rows):
        ddl = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
        full = [(i, t, g, s, None if t is None else len(t), *(["x"] * len(CLASHES))) for i, t, g, s in rows]
        return spark.createDataFrame(full, ddl)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empties, one word, ties, repeated rows, repeated ids, odd characters and a very long text."""
    rng = random.Random(5)
    words = ["alpha", "Beta,", "gamma.", "delta", "épsilon", "zeta", "eta", "theta x", "🌍", "iota"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long_text = "\n".join(prose(40) for _ in range(400))
    same = prose(60)
    return [
        (1, None, None, None), (2, "", "en", "a"), (3, "   \n\t ", None, "a"), (4, "word", "en", None), (5, "one two three four", "fr", "b"),
        (6, same, "en", "a"), (7, same, "en", "a"), (7, same, "en", "a"), (8, same.upper(), "de", "b"), (9, same + " tail", None, ""),
        (10, long_text, "en", "a"), (11, "x" * 200_000, "en", "b"), (12, "token = \"abcdef0123\" and " + "0123456789abcdef" * 3, "en", "c"),
        (None, "no id here at all", "en", "c"), (None, None, None, None), (13, "\x00\x1c odd   marks <|endoftext|>", "en", "c"),
    ]
