"""A small corpus with the awkward rows that every operator must take."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows(*texts, lang="en", source="s"):
    return [(i, t, lang, source, len(t or "")) for i, t in enumerate(texts)]


def awkward():
    long = " ".join(f"word{i % 977} and{i % 31}" for i in range(30_000))
    return [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n ", "en", "a", 4), (4, "one", None, "b", 3), (5, long, "en", "b", len(long)), (5, long, "en", "b", len(long)),
        (6, "日本語のテキスト é ß 😀 \U0001f600 end", "de", None, 10), (None, "no id here at all, twice", "en", "a", 9), (7, "12 34 ... !!", "fr", "c", 5), (8, "a\x00b \x1c c", "fr", "c", 5),
    ]


def frame(spark, data, schema=DOCS):
    return spark.createDataFrame(data, schema)


def clashing(df):
    """Columns with names that operators use themselves."""
    from pyspark.sql import functions as F

    given = [c for c in ("key", "size", "run", "sig", "b", "component", "ids", "shard", "html2", "copies", "level", "t", "w", "row", "_row", "_copy", "_copies", "text_key", "tag", "keep", "tree", "digest", "index") if c not in df.columns]
    return df.withColumns({c: F.lit("x") for c in given})
