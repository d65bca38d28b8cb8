import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, row string, digest string"
#: Names that the operators use for columns of their own.
CLASHING = "_id _digest _text _mix_id _mix_due its_id its_digest whole_text its_row mix_due mix_number mix_id mix_no_source mix_source mix_mark fp node first group start n mean x0 toxic part".split()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and ids, columns with clashing names."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    long = " ".join(words[(k * k + k // 7) % 10] + str(k % 97) for k in range(30_000))
    rows = [
        (1, None, None, None, None, None, None, None),
        (2, "", "en", "a", 0, "k", "r", "d"),
        (3, "", "en", "a", 0, "k", "r", "d"),
        (4, " \t\n\x0b\x0c\r ", "en", None, 7, None, "r", "d"),
        (5, "One two three four five six seven.", "en", "a", 34, "k", None, "d"),
        (6, "One two three four five six seven.", "de", "b", 34, "k", None, "d"),
        (6, "One two three four five six seven.", "de", "b", 34, "k", None, "d"),
        (None, "One two three four five six seven.", None, "b", 34, "k", None, "d"),
        (7, long, "en", "b", len(long), "k", "r", None),
        (8, long + " end", "en", "b", len(long) + 4, "k", "r", None),
        (9, "caf\u00e9 cafe\u0301 na\u00efve \u4f60\u597d\u4e16\u754c \u0391\u03a3 \u03a3\u03a3 \u0130 \ud83d\ude00\ud83d\ude00 x\u00a0y\u2003z\u3000w a\x1cb \x85 it's WE'LL 123 4.5%% <|endoftext|>tail<|startoftext|> aaaaaaa".encode("utf-16", "surrogatepass").decode("utf-16"), "fr", "c", 1, "k", "r", "d"),
        (10, "#### !!!! \n\n  two  spaces\t\ttabs\n \n x \r\n y   ", "fr", "c", 1, "k", "r", "d"),
        (10, "another text under the same id", "fr", "", 1, "k", "r", "d"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing_docs(odd_docs):
    """The odd rows with columns that are named as the operators name their own."""
    from pyspark.sql import functions as F

    return odd_docs.select("*", *(F.col("doc_id").alias(n) for n in CLASHING))
