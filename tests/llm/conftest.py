import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, part string, ids string, n_words int, kind string, c string"


def _row(i, text, lang="en", source="s"):
    return (i, text, lang, source, None if text is None else len(text), -1, "x", "y", 7, None, "z")


@pytest.fixture(scope="session")
def texts():
    """Texts with shared passages, copies, near copies, odd white space, special strings and a long one."""
    rng = random.Random(4)
    words = ["the", "and", "of", "hation", "ernd", "Über", "é", "it's", "won't", "12", "x9", "日本", "sting,", "end."]
    say = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", "er", "ing"]) for _ in range(n))
    passage, base = say(60), say(150)
    out = [None, "", " ", "a", "!!! ###", "one two", "\n\n a\tb  c\r\n", "<|endoftext|> x<|endoftext|>", "a" * 500, "ab " * 300, base, base, base.replace("the", "teh", 1)]
    out += [say(20) + " " + passage + " " + say(rng.randint(1, 80)) for _ in range(12)]
    out += [say(rng.randint(1, 200)) for _ in range(25)] + ["line one here\n" * 5 + say(50), say(30) + " ### $$$ &&& " * 40, say(9000)]
    return out


@pytest.fixture(scope="session")
def edge(spark, texts):
    """A table with nulls in every column, repeated rows, ties and columns whose names the operators use themselves."""
    rows = [_row(i, t, ["en", "fr", None][i % 3], ["s", None][i % 2]) for i, t in enumerate(texts)]
    rows += [rows[20], rows[20], _row(None, texts[21]), _row(None, None, None, None), _row(20, "another text for one id")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
