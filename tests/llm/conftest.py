import pytest

#: Columns whose names operators use themselves, in the input and with other types.
CLASHES = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, kept int, score string, row int, n_words string, sequence_id string, label string, start double"

LONG = " ".join(f"word{k % 977} of{k % 13}" for k in range(60_000))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty, blank and very long texts, repeated rows and repeated ids."""
    texts = [(None, None), (1, None), (2, ""), (3, " \n\t \x0b"), (4, "one"), (4, "one"), (5, "one two"), (6, LONG), (None, "a null id has words too"), (7, "Ünïcode ß 'S … \x00 中文 <|endoftext|>"), (8, "one two three four five six")]
    return [(i, t, None, None, None, "x", 1, "y", 2, "z", "q", "l", 0.5) for i, t in texts]


@pytest.fixture(scope="session")
def edges(spark, edge_rows):
    return spark.createDataFrame(edge_rows, CLASHES).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], CLASHES)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
