import random

import pytest

DDL = "doc_id long, text string, lang string, source string, n_chars long, h long, key string, n long, id long"


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]) + str(rng.randrange(40)) for _ in range(n)) + "."


@pytest.fixture(scope="session")
def corpus():
    """Texts of every defined case: null, empty, blank, short, long, copies, near copies, shared passages."""
    rng = random.Random(9)
    texts = [None, "", "  \n\t ", "a", "a b", "...", "42", "\U0001f600 é ñ"]
    base = words(rng, 120)
    texts += [base, base, base.replace("alpha", "alphas", 1), base + " tail", words(rng, 30) + "\n" + base]
    for k in range(12):
        w = base.split()
        w[k * 7 + 3] = f"changed{k}"
        texts.append(" ".join(w))
    passage = " ".join(words(rng, 13) for _ in range(5))
    texts += [words(rng, 40) + " " + passage + " " + words(rng, 40) for _ in range(4)]
    line = words(rng, 12)
    texts += [words(rng, 20) + "\n" + line + "\n" + words(rng, 25), line[:-1] + "!\n" + words(rng, 22), "x" + line, line + "yz", line + "\n" + line]
    texts += [words(rng, 60) for _ in range(20)] + [words(rng, 9000)]
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The texts with columns of names that operators use themselves."""
    rows = [(d, t, ["en", "fr", None][d % 3], f"s{d % 4}", len(t or ""), 1, "k", 2, 3) for d, t in corpus]
    return spark.createDataFrame(rows, DDL)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DDL)
