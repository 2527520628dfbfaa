import pytest

EDGES = [
    (1, "", "en", "src1"), (2, None, "en", None), (3, " ", "de", "src1"), (4, "a b  c\t\n d ", None, "src2"),
    (5, "plain words, 12 of them's", "en", "src2"), (5, "plain words, 12 of them's", "en", "src2"),
    (5, "same id, other text", "en", "src2"), (None, "no id", "en", "src0"), (7, "naïve café    x 中文字 🙂🙂 \x1c\x1d a", "fr", ""),
    (8, "x" * 5000 + " " + "ab" * 3000, "en", "src0"), (9, "1234567890" * 40 + "!!!---" * 50, "en", "src0"),
    (10, "<|endoftext|> is text  ", "en", "src3"), (11, "word " * 9000, "de", "src3"), (12, "  lead\r\n\r\n end  \n", "es", "src3"),
]


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls, empty and long texts, repeated rows and ids, odd white space, extra clashing columns."""
    rows = [(*r, len(r[1] or ""), 1, "x") for r in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, ids int, size string")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture
def folder(spark, tmp_path_factory):
    """Write tables of a test as a scale-factor folder."""

    def write(**tables):
        at = tmp_path_factory.mktemp("sf")
        for name, df in tables.items():
            df.write.parquet(f"{at}/{name}.parquet")
        return str(at)

    return write
