import pytest

#: Awkward rows of a documents table: null, empty, white space, one word, a very long text, copies, repeated ids.
AWKWARD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "tab\tand  two spaces\n\n中文 ½ <|endoftext|>"), (6, "long " * 40_000), (7, "same text of several words here now"),
    (8, "same text of several words here now"), (8, "same text of several words here now"), (None, "no id at all but several words"), (9, "naïve café ﬁn 😀"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame([(i, t, "en", "src", 1.5) for i, t in AWKWARD], "doc_id long, text string, lang string, source string, score double")


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
