import random

import pytest

#: Texts with copies, near copies, shared passages, personal data, junk, and the awkward cases.
ODD = [None, "", " ", "\n\n", "word", "a b c d", "É ñ ß 漢字 한글 🙂‍🙂", "<|endoftext|> x", "x" * 3000, "  lead   and\t\ttabs \r\n end  ", "it's we'll 'll ''s  !!  12 345\n\n\n z", "a b c\u0085d\x1ce"]


def make_texts(seed: int = 3, n: int = 120) -> list[str | None]:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 7))) for _ in range(400)]

    def words(k: int) -> list[str]:
        return [rng.choice(vocabulary) for _ in range(k)]

    passage, long = words(60), words(35)
    texts: list[str | None] = []
    for i in range(n):
        w = words(rng.randint(1, 150))
        if i % 7 == 0:
            at = rng.randint(0, len(w))
            w[at:at] = passage[rng.randint(0, 10) : 50 + rng.randint(0, 10)]
        if i % 11 == 0:
            w += long
        if i % 13 == 0:
            w += ["mail", f"user{i}@example.com", "from", "10.2.3.4", "+1 (555) 123-4567", "4111 1111 1111 1111"]
        text = " ".join(x + rng.choice(["", "", ".", "\n"]) for x in w)
        texts.append(text)
        if i % 9 == 0:
            texts += [text, text.replace(" ", "  ", 1)]
        if i % 10 == 0 and len(w) > 100:
            edited = w[:]
            edited[50] = "changed"
            texts.append(" ".join(edited))
            texts.append(" ".join(w))
    return texts + ODD + ODD[1:4]


@pytest.fixture(scope="session")
def texts():
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """doc_id, text, lang, source, n_chars: with nulls, repeated ids are tested apart."""
    rows = [(i, t, None if i % 17 == 0 else "en", None if i % 19 == 0 else f"src{i % 14}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5, "doc_id")


@pytest.fixture(scope="session")
def awkward(spark):
    """Repeated rows, a null id, nulls in every column and columns whose names clash with the operators' own."""
    rows = [(1, "same text here", "s", 5, "x"), (1, "same text here", "s", 5, "x"), (2, "same  text here", None, None, None), (None, "same text here", "t", 1, "y"), (None, None, None, None, None), (3, "", "s", 2, "z"), (4, None, "s", 2, "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens int, kept string").withColumnsRenamed({}).selectExpr("*", "source as lang", "n_tokens as ids", "kept as spans", "kept as node", "n_tokens as norm", "kept as __at", "n_tokens as x")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
