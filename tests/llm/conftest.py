import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, tokens string, row int, lines string, gone boolean, word string, rank int, n long"


@pytest.fixture(scope="session")
def nasty(spark):
    """Documents with nulls, empty and very long texts, repeated rows, special tokens and columns of clashing names."""
    rng = random.Random(11)
    words = ["the", "thlyou", "Éireau", "straße", "梦想", "a", "Ouwhea", "it's", "12345", "—", "🙂🙂", "x" * 40]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = some(300)
    texts = [
        None, "", " ", "\n\n\t", "one", "one two three", "<|endoftext|>", f"a<|endoftext|> b {some(5)}", base, base, base.replace("the", "THE", 1), some(6000), "y" * 30_000,
        "\n".join(some(12) for _ in range(40)), "double  blanks   and\ttabs \n here ", "tail blank ", " lead blank", "a b c d", "\x00nul\x1c", some(2048), "same line of eight or more words here now\n" * 3,
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, base), (None, None), (9, base), (7, "another text with the same id")]
    return spark.createDataFrame([(i, t, None if k % 3 else "en", None if k % 4 == 0 else "src0", None if t is None else len(t), 0.5, "t", k, "l", True, "w", 1, 2) for k, (i, t) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
