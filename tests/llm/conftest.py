import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def word(rnd, language):
    parts = {"en": ["th", "ing", "er", "an", "wh"], "fr": ["é", "eau", "ou", "ç", "tre"], "de": ["sch", "ein", "ü", "keit", "ver"]}[language]
    return "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 3)))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Ordinary texts, copies and near copies, nulls in every column, empty and long texts, repeated rows."""
    rnd, rows = random.Random(7), []
    for k in range(60):
        language = rnd.choice(["en", "fr", "de"])
        rows.append((k, " ".join(word(rnd, language) for _ in range(rnd.randint(5, 80))), language, f"s{k % 3}", 1))
    base = rows[5][1]
    rows += [(100 + k, base, "en", "s0", 1) for k in range(30)]  # a third are copies
    rows += [(140 + k, base + f" tail{k}", "en", "s0", 1) for k in range(5)]
    rows += [(150, None, "en", "s0", 0), (151, "", None, None, None), (None, "a b c d e", "en", None, 1), (None, None, None, None, None), (152, " \t\n ", "fr", "s1", 4), (153, "12 34 !!", None, "s1", 8)]
    rows += [(154, "wording " * 30000, "en", "s1", 9), (155, "x" * 70000, "en", "s1", 9), (156, "日本語 😀 ａ\u0000b ▁ é\r\n", "fr", "s1", 9)]
    rows += [rows[3], rows[3]]
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
