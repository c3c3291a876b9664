"""Small tables with every odd case: nulls in any column, empty and long texts, ties, repeated rows, clashing names."""
import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return [f"w{int(rng.random() ** 2 * vocabulary)}" for _ in range(n)]


def odd_documents(seed=1):
    rng = random.Random(seed)
    base = words(rng, 90)
    shared = words(rng, 40)
    rows = [
        (1, " ".join(base), "en", "a", 1), (2, " ".join(base), "en", "a", 1),                    # copies
        (3, " ".join(base[:50] + ["zz"] + base[51:]), "en", "b", 1),                             # a near copy
        (4, " ".join(words(rng, 30) + shared + words(rng, 30)), "de", None, None),
        (5, "\t".join(words(rng, 10) + shared) + "\r\n", "de", "b", 7),
        (6, None, "en", "a", None), (7, "", None, "c", 0), (8, " \n\t ", "fr", "c", 3), (9, "one two", "en", None, 7),
        (10, "the same " * 60, "en", "b", 5), (11, "12 34 -- !! 56", None, "a", 9),
        (12, "Élan vital, naïve ÜBER straße don't it's  x y", "fr", "a", 3),
        (13, " ".join(words(rng, 9000, 3000)), "en", "a", 1),                                    # very long
        (14, "One Two three FOUR", "en", "b", 1), (15, "one two THREE four", "en", "b", 1),
        (None, " ".join(base), "en", "a", 1), (None, None, None, None, None), (None, "lonely words here", "en", "c", 2),
    ]
    rows += [(20 + i, " ".join(words(rng, rng.randrange(1, 80))), rng.choice(["en", "de"]), rng.choice("abc"), 1) for i in range(40)]
    rows += [rows[0], rows[3]]                                                                   # repeated rows
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    """The odd documents with extra columns whose names clash with the operators' own."""
    df = spark.createDataFrame(odd_documents(), SCHEMA).repartition(5)
    return df.selectExpr("*", "0 AS size", "'x' AS score", "1 AS label", "2 AS bucket", "3 AS copies", "4 AS th", "5 AS dk", "'q' AS target",
                         "6 AS start", "7 AS component_id", "8 AS n", "9 AS positive", "1.5 AS rank")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
