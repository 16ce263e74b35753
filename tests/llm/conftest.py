"""Tables for the operators of the llm subpackage."""

import pytest

SF = "/root/testdata/sf0.01"
CLASHING = (
    "score long, predicted string, held_out long, n_lines string, n_dropped string, kept_text long, node string, n long, hash string, "
    "key string, position string, size string, rank string, sequence_id string, host string, verdict string, label string, kept string, n_words string, "
    "of long, hot string, words string, pattern string, order string, weight string, target string, source_size long, payload string, component long"
)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}


ODD = [
    (1, "a b c d e f g h", "src0"), (2, None, "src1"), (3, "", "src1"), (4, " \t\n \r\n ", None), (None, "a b c d e f g h", "src0"),
    (5, "word " * 30_000, "src0"), (6, "One line\nONE LINE \n\none line", "src2"), (6, "One line\nONE LINE \n\none line", "src2"),
    (7, "x", "src2"), (8, "naïve Ünï \x1f\x85\xa0 <|endoftext|> 日本語 don't 3½", None), (9, "y" * 200_000, "src0"), (None, None, None),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and extra columns with clashing names."""
    n = len(CLASHING.split(", "))
    rows = [(i, t, "en", s, len(t or ""), *([None] * n)) for i, t, s in ODD]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}").repartition(3)
