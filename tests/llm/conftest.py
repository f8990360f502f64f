import pytest

LONG = " ".join(f"word{i % 977} thing{i % 31}" for i in range(20_000))
TEXTS = {
    1: "The first line of this text says a thing or two about boats\nand a second line follows it here",
    2: "The first line of this text says a thing or two about boats\nand a second line follows it here",
    3: "the first line of this text says a thing or two about ships\nsomething else entirely is written on this line",
    4: "",
    5: LONG,
    6: "12 34 --- !!",
    7: "Ünïcode Straße 😀 naïve façade, mail a.b@c.org or +49 30 1234567",
}
ROWS = [(i, t) for i, t in TEXTS.items()] + [(3, TEXTS[3]), (None, "a text without a key"), (8, None), (None, None)]
#: Columns that have the names of what operators return or use on the way.
CLASHING = "key row th ids decoded n_words n_hit items windows spans terms base fp component root node shard depth shard_bytes cell bits line kept score n_tokens lang_pred id v label".split()


@pytest.fixture(scope="session")
def messy(spark):
    """Null keys and texts, empty and long texts, repeated rows, and extra columns with clashing names."""
    schema = "doc_id BIGINT, text STRING, " + ", ".join(f"`{c}` STRING" for c in CLASHING)
    return spark.createDataFrame([(i, t, *["x"] * len(CLASHING)) for i, t in ROWS], schema).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.where("false")
