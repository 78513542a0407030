"""Small inputs with everything that may go wrong."""

from pyspark.sql import types as T

LONG_WORD = "x" * 60_000
MANY_WORDS = " ".join(f"w{i % 997}" for i in range(30_000))
TEXTS = [
    (1, "Plain words in a short text, no harm done."), (2, None), (3, ""), (4, " \n\t "), (5, LONG_WORD), (6, MANY_WORDS),
    (7, "one two three four five six seven"), (7, "one two three four five six seven"), (8, "one two three four five six seven"),
    (9, "ab cd"), (10, "ab cd"), (None, "a text without an id"), (None, None), (11, "(" * 3000 + "@" * 3000 + "1" * 5000 + "." * 50),
    (12, "naïve 日本語 😀     x\r\ny <|endoftext|> ▁ mail a.b@example.org or +1 (743) 555-3824, 4111 1111 1111 1111; 10.0.0.1"),
    (13, "Licensed under the Apache License, Version 2.0.\nsame\nsame\n" + "again and again " * 40),
]
CLASHING = ["kept", "n_words", "key", "rep", "cluster", "_text", "spans", "digest", "gram", "score", "base_failed", "n_symbols", "_ws", "value", "_d"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def documents(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, None if i == 3 else "en", "src0", None if t is None else len(t)) for i, t in rows], SCHEMA)


def clashing(df):
    """The frame with extra columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(f"extra {c}") for c in CLASHING})


def write_tables(spark, folder, docs, labels=(), benchmark=(), pages=(), conversations=()):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality long, toxic long").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(list(pages), "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame(list(conversations), "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return str(folder)
