import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and extra columns named like results."""
    text = "the quick brown fox jumps over the lazy dog near the river bank every day at noon"
    rows = [
        (1, text, "en", "a", 10),
        (1, text, "en", "a", 10),
        (2, text, None, "a", None),
        (3, None, "en", None, 0),
        (4, "", "en", "b", 0),
        (None, text, "en", "b", 1),
        (None, None, None, None, None),
        (5, " \t\n ", "de", "b", 4),
        (6, " ".join(f"w{i}" for i in range(20_000)), "de", "b", 9),
        (7, "é Ünï 漢字 😀 \x00 ퟿", "xx", "c", 9),
    ]
    extra = "_id _key _row key print component_id words kept slot shard spans ids class c1 first place".split()
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("*", *[f"'x' AS {name}" for name in extra])


@pytest.fixture
def none(odd):
    return odd.limit(0)
