import random

#: Documents whose columns hold nulls, empties, ties and repeated rows; one column clashes.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, grp string"


def frame(spark, rows, schema=SCHEMA):
    """rows: (doc_id, text) pairs or longer; the other columns are null."""
    width = len(schema.split(","))
    return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], schema)


def prose(seed, words, vocabulary=400):
    r = random.Random(seed)
    return " ".join("w%x" % r.randrange(vocabulary) for _ in range(words))


ODD = [(None, None), (None, "alone here with words"), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "Two words"), (6, "two WORDS"), (7, "x" * 5000), (7, "x" * 5000)]
