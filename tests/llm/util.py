"""Small fixtures: odd documents that every operator must take."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, salt string, chunk string"


def frame(spark, texts, first=0):
    """Documents with two extra columns whose names clash with those operators use inside."""
    rows = [(first + i, t, "en", "s", len(t or ""), "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


ODD = [None, "", " ", "\n\n", "a", "é", "the the the", "The THE the", None, "ß İ ﬁ x́ á", "<|endoftext|> it's 42\t x", "a" * 70_000, "word " * 20_000, "a\x00b", "日本語 テキスト　です", "the the the"]
