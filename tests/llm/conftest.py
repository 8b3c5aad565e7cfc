import random

import pytest

WORDS = {
    "en": "the of and to in is that for it was on are with as his they be at one have this from or had by hot word but what some we can out other were all there when up use your how said".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über".split(),
    "fr": "le de un être et à il avoir ne je son que se qui ce dans en du elle au pour pas vous par sur faire plus dire me on mon lui nous comme mais pouvoir avec tout".split(),
}


def prose(rng, lang="en", words=60):
    out = [rng.choice(WORDS[lang]) + (rng.choice(WORDS[lang]) if rng.random() < 0.4 else "") for _ in range(words)]
    return " ".join(out).capitalize() + "."


@pytest.fixture
def rng():
    return random.Random(7)


ODD = "doc_id long, text string, lang string, source string, n_chars long, id long, score double, n long, row string, key long, size long, n_lines long"


@pytest.fixture
def odd_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, columns with names that operators use."""
    long = "word and another word " * 30_000
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "   \n\n ", "en", "a", 5), (4, long, "en", None, len(long)), (5, "one", "en", "b", 3), (5, "one", "en", "b", 3), (6, "one", None, "b", 3), (None, "no id here", "en", "b", 10), (7, "12 34 !! ??", "de", "a", 11), (8, "ÄÖ ünïcode 日本語 text\0zero", "de", "a", 20)]
    return spark.createDataFrame([(*r, 9, 0.5, 9, "x", 9, 9, 9) for r in rows], ODD)


@pytest.fixture
def no_docs(spark, odd_docs):
    return odd_docs.limit(0)
