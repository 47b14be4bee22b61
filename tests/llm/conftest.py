import pytest

LONG = " ".join(f"word{i % 977} the of and" for i in range(30_000))
TEXTS = [
    None,
    "",
    "   \n\t ",
    "one two three",
    "One two three",
    "The quick brown fox jumps over the lazy dog near the old river bank at dawn",
    "The quick brown fox jumps over the lazy dog near the old river bank at dawn",
    "Größe über Straße für Mädchen — 漢字 и кириллица",
    "<|im_end|> \\ <\\| <| \\\\",
    LONG,
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, a null id, columns whose names clash with those of operators."""
    rows = [(i, t, "en", "s", None, 1.5, 7) for i, t in enumerate(TEXTS)]
    rows += [rows[5], (None, "no id here at all", None, None, None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, component_id long")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
