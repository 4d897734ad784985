import pytest


@pytest.fixture(scope="session")
def tokenizers_path():
    import public_tokenizers

    return public_tokenizers.path


#: doc_id, text, lang, and columns whose names the operators use themselves.
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, r string, rejected int, ids string, `print` int, kept string"
TEXTS = [
    None,
    "",
    " \t\n\x0b",
    "word",
    "the quick brown fox",
    "one  two   three\n\nfour \n five",
    "long " * 30_000,
    "x" * 60_000,
    "ÀÉÎ straße ñandú 日本語 🙂🙂",
    "12 34 !! ## $$",
    "tie tie tie",
    "tie tie tie",
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls everywhere, empty, blank and very long texts, ties, repeated rows, and clashing extra columns."""
    rows = [(k, t, "en" if k % 2 else None, None, None, "s", "r", 1, "i", 2, "k") for k, t in enumerate(TEXTS)]
    rows += [rows[4], rows[4], (None, "no key at all", None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="session")
def small(spark):
    return "/root/testdata/sf0.001"
