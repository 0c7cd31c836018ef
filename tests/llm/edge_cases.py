"""Rows that every operator must take: nulls, empty and long texts, ties, repeated rows, clashing column names."""

LONG = "word " * 30_000 + "é" * 5_000 + " " + "x" * 20_000
TEXTS = ["", None, " \n\t ", "one", "two words", "same text again\nsame text again", "same text again\nsame text again", LONG, "日本語 のテキスト 🙂\n" * 3, "a\u0000b <|endoftext|> \u0085 c"]
#: Columns that have the names the operators use themselves.
SCHEMA = "doc_id long, text string, n_words string, fingerprint string, place string, ids string, _a string, kept string"


def documents(spark):
    rows = [(i if i not in (3, 6) else None, t) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5]), (5, TEXTS[5])]
    return spark.createDataFrame([(*r, "x", None, "y", "z", "q", None) for r in rows], SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
