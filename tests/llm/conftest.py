import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, rank string"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty, blank and very long texts, ties, repeated rows, and extra columns with clashing names."""
    long_text = " ".join(f"word{i % 977}x{i % 13}" for i in range(30_000))
    rows = [
        (1, "the same words stand here again and again", "en", "a", 41, "x", "y", "z"),
        (2, "the same words stand here again and again", "en", "a", 41, "x", "y", "z"),
        (3, " the same  words stand here again and again\n", "en", "b", 44, None, None, None),
        (4, None, None, None, None, None, None, None),
        (5, "", "en", "b", 0, "x", "y", "z"),
        (6, " \t\n", "de", None, 3, "x", "y", "z"),
        (7, long_text, "en", "a", len(long_text), "x", "y", "z"),
        (8, long_text + " tail", "en", "c", len(long_text) + 5, "x", "y", "z"),
        (9, "ein kurzer Satz über Äpfel, 123 !!", "de", "c", 34, "x", "y", "z"),
        (10, "<|endoftext|> it's ’quoted’ é́ Å ΑΣ 漢字 🙂", None, "c", 40, "x", "y", "z"),
        (9, "ein kurzer Satz über Äpfel, 123 !!", "de", "c", 34, "x", "y", "z"),
        (None, "a row without id", "en", "a", 16, "x", "y", "z"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
