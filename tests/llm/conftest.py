import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def rows():
    """Edge cases, exact and near copies, ties, repeated rows, and some plain texts."""
    rng = random.Random(5)
    vocab = ["alpha", "Beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "über", "naïve", "日本", "ÀB", "x1"]
    out = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t\x0b\x0c\r ", "en", "a", 3), (4, "One", "en", None, 3), (5, "one", "en", "b", 3),
        (6, "o n e", "en", "b", 5), (6, "o n e", "en", "b", 5), (None, "one", "en", "a", 3), (None, None, None, "c", None), (7, "1 2 3", "xx", "c", 5),
        (8, " a b\u0085c", "en", "c", 5), (9, "K İ ß 😀 \x00 ́", "de", "c", 10), (10, "a" * 70000, "de", "c", 70000), (11, "lorem ipsum " * 4000, "de", "c", 1),
    ]
    for i in range(100, 160):
        out.append((i, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 60))), rng.choice(["en", "fr"]), rng.choice("abcd"), 1))
    for i in range(200, 240):
        text = out[20 + i % 9][1] or ""
        out.append((i, text + rng.choice(["", " ", "\n", " end", "x"]), "en", rng.choice("abcd"), 1))
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With extra columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, DOCS)
    for c in ("id", "uid", "len", "head", "full", "fp", "size", "key", "target", "text_", "kept", "lang_pred", "s", "ids", "text_hash", "k_id", "d_hash", "rank"):
        df = df.selectExpr("*", f"'extra' AS {c}")
    return df


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")
