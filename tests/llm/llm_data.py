"""Small tables with the awkward cases that every operator must give a defined result for."""

import random

FIELDS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside or return; as extra columns they must not get in the way.
CLASHES = ["score", "size", "copies", "bits", "part", "_id", "_key", "_text", "c0", "n0", "row", "words", "at", "hash", "text_key"]

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(seed, n, words=WORDS):
    pick = random.Random(seed)
    out = []
    for k in range(n):
        w = pick.choice(words)
        out.append(w.capitalize() + "." if k % 9 == 8 else w)
    return " ".join(out)


def rows():
    long_text = prose("long", 9000) + "\nÄpfel straße 日本語 ñandú " * 50
    base = prose("base", 120)
    near = base.replace("alpha", "omega", 1)
    made = [
        (1, base, "en", "a", None),
        (2, base, "en", "a", 5),
        (2, base, "en", "a", 5),
        (3, near, "en", None, 5),
        (4, None, None, None, None),
        (5, "", "en", "b", 0),
        (6, " \t\n ", "en", "b", 4),
        (7, long_text, "de", "c", len(long_text)),
        (None, prose("anon", 40), "en", "c", 3),
        (8, "one", "en", "a", 3),
        (9, "one two three", "en", "d", 3),
        (10, "one two three four", "en", "d", 3),
        (11, "\x1c odd \x1f separators\x0b and \x0c more", "en", "d", 3),
    ]
    return made + [(100 + k, prose(k, 15 + 7 * k), "en", "abcd"[k % 4], k) for k in range(30)]


def docs(spark, made=None):
    return spark.createDataFrame(rows() if made is None else made, FIELDS)


def with_clashes(df):
    from pyspark.sql import functions as F

    for name in CLASHES:
        df = df.withColumn(name, F.lit("clash"))
    return df


def plain(df):
    return sorted(map(tuple, df.collect()), key=str)
