"""Small tables that hold every edge case: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start long, piece int, score double, words string, k1 long"


def edge_docs(spark, extra=()):
    long_text = "lorem ipsum dolor sit amet " * 4000
    rows = [
        (1, "The quick brown fox jumps over the lazy dog.", "en", "a"),
        (1, "The quick brown fox jumps over the lazy dog.", "en", "a"),
        (2, None, "en", "a"),
        (3, "", None, "a"),
        (4, long_text, "la", None),
        (None, "no identifier here", "en", "b"),
        (5, "a  b \n\n c\t d   ", "en", "b"),
        (5, "same id, other text", "en", "b"),
        (-7, "É́ naïve 日本語 <|endoftext|> x@y.example.org", "fr", "b"),
        *extra,
    ]
    return spark.createDataFrame([(*r, None, 9, 9, 0.5, "w", 3) for r in rows], DOC_SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
