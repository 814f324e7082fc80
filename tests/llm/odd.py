"""A small table with everything that is awkward: nulls, empty and very long texts, ties, repeated rows, clashing extra columns."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(("", "", "", ",", ".")) + str(r.randrange(50)) for _ in range(n))


ROWS = [
    (0, "", "en", "a"), (1, None, "en", "a"), (None, prose(1, 30), "en", "a"), (None, None, None, None), (2, prose(2, 25_000), "en", "a"),
    (3, prose(3, 40), "en", "b"), (3, prose(3, 40), "en", "b"), (4, prose(3, 40), None, "b"), (5, prose(3, 40) + " tail", "fr", None), (6, " \t\n ", "fr", None),
    (7, prose(7, 200), "de", "c"), (8, prose(7, 200).replace("alpha", "ALPHA"), "de", "c"), (9, prose(7, 190), "de", "c"), (10, "one two", "es", "b"), (11, "one two", "es", "b"),
    (12, "héé wörld ñ 日本 <|endoftext|> don't", "es", "a"), (13, "line one here\nline one here\nline one here", "en", "b"), (-5, prose(5, 12), "en", "b"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept int, size string, shard string, rep string, bucket string, comp string, row string, words string"


def odd_documents(spark):
    rows = [(d, t, lang, s, len(t or ""), 1, "x", "x", "x", "x", "x", "x", "x") for d, t, lang, s in ROWS]
    return spark.createDataFrame(rows, SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows=((2, 1, 0), (3, 1, None), (7, 0, 1), (None, 1, 1), (8, 0, 0))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def key(row):
    return tuple((v is None, str(v)) for v in row)
