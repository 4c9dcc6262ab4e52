"""Documents with the odd cases that every operator must handle."""

ODD = [
    (1, "one two three four five six"),
    (2, "one two three four five six"),
    (3, "one  two\tthree four\nfive six"),
    (4, None),
    (5, ""),
    (6, "   "),
    (7, "short"),
    (8, "x" * 70_000),
    (9, "wörd É " * 9_000),
    (None, "one two three four five six"),
    (2, "one two three four five six"),
    (10, "a different text altogether, with a few more words"),
]


def odd(spark, extra=True):
    rows = [(i, t, "s1" if k % 3 else None, "x", 1.5, "clash") for k, (i, t) in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, kept string, score double, fp string")
    return df if extra else df.select("doc_id", "text")


def empty(spark):
    return odd(spark).limit(0)
