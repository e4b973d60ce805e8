"""Small tables for the tests of the llm operators."""

import random

WORDS = "ash birch cedar dogwood elm fir gum hazel ivy juniper kapok larch maple nutmeg oak pine quince rowan spruce teak".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def odd_documents(spark):
    """Null and empty texts, one very long text, repeated rows, white space only, a null id, and columns with clashing names."""
    long = prose(1, 60_000)
    rows = [(1, None, "a"), (2, "", "a"), (3, prose(2, 80), "a"), (4, prose(2, 80), None), (5, long, "b"), (6, " \n\t ", "b"),
            (7, "one", "b"), (7, "one", "b"), (8, "Grüße, <|endoftext|>\r\n\r\n naïve  ٣ text… \n end", "c"), (None, prose(3, 70), "c")]
    return spark.createDataFrame([(i, t, "en", s, -1 if t is None else len(t), "x", "y", 0.5, "z", True, 4)
                                  for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, "
                                 "_text_bytes string, key string, score double, line string, kept boolean, node long")


def empty_like(df):
    return df.filter("1 = 0")


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
