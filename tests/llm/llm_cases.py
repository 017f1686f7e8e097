"""Rows for the edge cases every operator meets: nulls, empty and long texts, repeated
rows, ties and extra columns with clashing names."""

LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))
EDGE = [
    (1, "the cat sat on the mat and the dog sat on the rug " * 8, "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, None),
    (4, " \t\n\x0b\x0c\r ", "en", "b"),
    (5, LONG, "de", "b"),
    (6, "one", "en", "b"),
    (6, "one", "en", "b"),
    (7, "The Cat sat on the mat and the dog sat on the rug " * 8, "en", "a"),
    (None, "the cat sat on the mat", None, None),
    (8, "Ünïcödé ßtraße Σίσυφος ÇA ĲSSEL ﬁn 日本語 \U0001F600 e\u0301 <|endoftext|> x\u2028y\x1cz  a", "fr", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string, _id int, _text string, score double, set int, tile string"


def edge_docs(spark):
    return spark.createDataFrame([(*r, 9, "clash", 0.5, 1, "t") for r in EDGE], SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
