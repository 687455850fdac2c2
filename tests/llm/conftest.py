import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept int, fp string, component_id string, _mix_id int, TARGET string, ids int, n_tokens int, keys int"


def _sentence(rng, vocabulary, n):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Rows with nulls everywhere, empty, blank and very long texts, copies, near copies and repeated rows."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghiklmnoprstuvwz") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    long_text = _sentence(rng, vocabulary, 30_000)
    shared = "A line that many documents share, word for word."
    rows = []
    for k in range(60):
        body = "\n".join(_sentence(rng, vocabulary, rng.randint(3, 30)) for _ in range(rng.randint(1, 6)))
        rows.append((k, f"{shared}\n{body}" if k % 3 == 0 else body, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", None, "é"]), len(body)))
    rows += [
        (100, None, "en", "a", None), (101, "", "en", "b", 0), (102, " \t\n\x0b\x0c\r ", None, None, 7), (103, "x", "fr", "a", 1), (104, long_text, "en", "a", 1), (105, long_text + " more", "en", "b", 1),
        (None, "A row without an id.\n" + shared, "en", "a", 3), (None, None, None, None, None), (106, "ünï cödé ÀÉ 中文 🙂   İΣς " * 30, "de", "é", 2),
        (107, rows[4][1], "en", "b", 3), (108, rows[4][1].upper(), "en", "b", 3), (107, rows[4][1], "en", "b", 3),
        (109, shared + "\n" + shared.upper() + "  \n\n" + shared, "en", "c", 9), (110, "###***$$$ ||| " * 40, "en", "c", 9), (111, "word " * 500, "en", "c", 9),
        (112, "a" * 50_000, "en", "c", 9), (113, "<|endoftext|> it's <|startoftext|>'ll 1234 -- ½²", "en", "c", 9), (-5, "negative ids are ids too, as any " * 3, "en", "a", 1),
    ]
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame([(*r, 1, "f", "c", 2, "t", 3, 4, 5) for r in edge_rows], SCHEMA)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
