"""Small tables with every odd case: nulls, empty and long texts, ties, repeats, clashing names."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    long_line = "the quick brown fox jumps over the lazy dog near the river bank "
    texts = [
        None, "", "   \t\n ", "one", "Same line of text here\nother A", "same line of TEXT here \nother B", "SAME line of text here\n\n",
        long_line * 300, long_line * 300 + "tail", "x" * 30_000, "é漢字🙂 " * 50, "one", "o n e", "a\x0bb\x0cc\rd", "\n\n\n",
    ]
    out = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, len(t or "")) for i, t in enumerate(texts)]
    return [*out, out[5], (None, "text of a null id", None, None, None), (None, "Same line of text here", None, None, None), (-7, long_line * 3, "en", "s1", None)]


def documents(spark, data=None, names=()):
    """The rows, with more columns that operators might use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows() if data is None else data, SCHEMA)
    return df.withColumns({n: F.lit("other") for n in names})
