import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, node string, slot string"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def texts() -> dict[int, str | None]:
    """Documents with copies, near copies, shared passages, and the edges: null, empty, blank, short, long."""
    rng = random.Random(7)
    passage, base, benchmark = sentence(rng, 60), sentence(rng, 120), sentence(rng, 40)
    out: dict[int, str | None] = {0: None, 1: "", 2: " \t\n", 3: "One", 4: "one", 5: "two words", 6: "x" * 300_000}
    for i in range(7, 60):
        out[i] = sentence(rng, rng.randint(3, 200))
    for i in range(60, 72):
        out[i] = base
    for i in range(72, 90):
        words = base.split()
        words[rng.randrange(len(words))] = "changed"
        words[rng.randrange(len(words))] = f"w{i}"
        out[i] = " ".join(words)
    for i in range(90, 100):
        out[i] = f"{sentence(rng, 30)} {passage} {sentence(rng, 30)} é"
    out[100] = f"{sentence(rng, 20)} {benchmark.upper()} {sentence(rng, 10)}"
    out[101] = "password = abcdefgh1 and PASSWD:'short' token=\"04dbebab91ab85687d33eeaaf9ac699e1188f962\" é AKIAABCDEFGHIJKL9"
    out[102] = "mail a.b@c.de@f.gh +1 (017) 555-7713 10.0.0.1 999.1.1.1 4111 1111 1111 1111 12-34 1.2.3.4.5.6.7.8 é a@b"
    out[103] = "key kJ8s0dPq2LmZx9Rt4VbN7cYw1 or 123e4567-e89b-12d3-a456-426614174000 and thisisonlyalongwordwithoutanydigits"
    out[104] = passage
    out[105] = "💡" + passage[:120]
    return out


@pytest.fixture(scope="session")
def benchmark_items() -> dict[int, str | None]:
    rng = random.Random(7)
    sentence(rng, 60), sentence(rng, 120)
    return {7: sentence(rng, 40), 8: "one", 9: None, 10: "...", 11: "two words"}


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with columns whose names operators use inside."""
    rows = [(i, t, "en", None if i % 17 == 0 else f"s{i % 3 if i % 2 else 0}", len(t or ""), 1, "n", "s") for i, t in texts.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Repeated rows, repeated ids and null ids, beyond what floats hold."""
    big = 2**60 + 1
    rows = [(big, "some text of a few words here", "en", "a", 1, 1, "n", "s")] * 3
    rows += [(None, "some text of a few words here", "en", None, 1, 1, "n", "s")] * 2 + [(None, None, None, None, None, None, None, None)]
    rows += [(big, "another text under the same id", "en", "b", 1, 1, "n", "s")]
    return spark.createDataFrame(rows, SCHEMA)
