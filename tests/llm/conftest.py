import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    """Awkward texts: missing, empty, tied, repeated, long, and columns whose names clash."""
    long_text = " ".join(f"word{i % 700} of line{i}\n" for i in range(20_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "One two three. One two three."), (5, "One two three. One two three."),
            (6, "Été là-bas <b> \\s \U0001f600 ok"), (7, long_text), (8, long_text + "x"), (None, "no id"), (9, "no id"),
            (10, "a b c d e f g h"), (11, "a b c d e f g i"), (11, "a b c d e f g i")]
    clashing = ("id", "doc", "node", "row", "spans", "digest", "bits", "_gone", "_digest", "_node", "_id", "_doc", "_spans", "_quality",
                "_quality_text", "_passes", "_bucket")
    return spark.createDataFrame([(i, t, 7, "x", 0, *range(len(clashing))) for i, t in rows],
                                 "doc_id bigint, text string, n_words int, kept string, _length int, " + ", ".join(f"{c} int" for c in clashing))


@pytest.fixture(scope="session")
def no_documents(documents):
    return documents.limit(0)
