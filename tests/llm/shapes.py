"""Small tables with awkward rows, shared by the tests of this folder."""

SCHEMA = "doc_id bigint, text string, lang string, score string, k int, n int, body string, ids string, hash string"
LONG = "stone river cloud " * 4000


def awkward(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns named like the operators' own."""
    extra = ("x", 1, 2, "b", "i", "h")
    rows = [
        (1, "One two three four five six seven.\nA line here.\nAnd another line.", "en"), (2, None, "en"), (3, "", None), (None, "One two three", "de"),
        (4, LONG, "en"), (5, LONG, "en"), (6, "One two three", None), (6, "One two three", None), (7, " \t\n ", "fr"), (8, "Ünïcode – 日本語 🙂 a@b.example.org", None),
    ]
    return spark.createDataFrame([(*r, *extra) for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
