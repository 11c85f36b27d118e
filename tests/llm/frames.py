"""Small frames with what operators must bear: nulls, empty and long texts, repeats, and columns named like their own."""

CLASHING = "id long, fp long, seed long, source string, found string, chains string, n_tokens string, score string, kept string, text2 string"


def documents(spark, rows):
    """rows: (doc_id, text). With columns that clash with the operators' own names."""
    full = [(i, t, "en", "src", None if t is None else len(t), 1, 2, 3, "f", "c", "n", "s", "k", "t") for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, id long, fp long, seed long, found string, chains string, n_tokens string, score string, kept string, gone string")


ODD = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (3, "one"), (None, "no id here"), (None, None), (4, "x" * 50_000), (5, "word " * 20_000), (6, "日本語 テキスト 😀"), (7, "a b c\x1cd")]
