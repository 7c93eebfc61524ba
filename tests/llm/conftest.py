import random

import pytest

SF = "/root/testdata/sf0.001"

WORDS = ["the", "and", "of", "thing", "Über", "école", "niño", "ring", "erst", "tion", "ouble", "hand", "blé", "x1", "42"]


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + (rng.choice([",", ".", "\n", ""]) if rng.random() < 0.2 else "") for _ in range(n))


def odd_texts() -> list:
    """Nulls, empty, short and very long texts, ties and repeats."""
    rng = random.Random(5)
    long = sentence(rng, 30_000)
    base = sentence(rng, 80)
    words = base.split(" ")
    near = " ".join([*words[:78], "changed", "end"])
    return [
        None, "", " ", "\n\t ", "a", "a b", "a b", "one two three four", base, base, near, base.upper(), long, "!!! ??? ...", "12345 678", "日本語 テキスト です", "Привет мир",
        "don't  stop,   it's'll \r\n\r\n x y ", "a" * 5000, "<|endoftext|> text", "Licensed under CC BY-NC 4.0.", "x\u0000y", "😀 emoji 😀", "KKelvin ſecret=abcdefgh",
    ]


@pytest.fixture(scope="session")
def odd_docs(spark):
    texts = odd_texts()
    rows = [(i, t, "en" if i % 3 else None, "s", len(t) if t else 0, "clash", 1) for i, t in enumerate(texts)]
    rows += [(None, "no id here at all", "fr", None, None, "clash", 2), (3, texts[3], "de", "s", 1, "clash", 3), (8, texts[8], "de", "s", 1, "clash", 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, node string, n_shingles int"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
