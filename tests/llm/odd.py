"""Awkward tables that every operator has to take."""

from pyspark.sql import functions as F

LONG = "Ein sehr langer Text, der nicht endet. " * 20_000
TEXTS = [
    (1, "Released under the MIT License. Write to a.b@example.org now, or call +49 (30) 1234-5678."),
    (2, None),
    (3, ""),
    (None, "A text without an id, and some more words so that it is long enough."),
    (4, "same text here and there and everywhere it goes"),
    (5, "same text here and there and everywhere it goes"),
    (5, "same text here and there and everywhere it goes"),
    (6, " \n\t \r"),
    (7, LONG),
    (8, "🙂🙂 ünïcödé <|endoftext|> １２３ 4111 1111 1111 1111"),
]


def documents(spark):
    """Columns that clash with names of results, besides the usual ones."""
    rows = [(i, t, "en", "src0", len(t or ""), 0.5, True, "x", [1]) for i, t in TEXTS]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, component_id string, ids array<int>"
    return spark.createDataFrame(rows, schema)


def nulls(spark):
    """Every column null."""
    return documents(spark).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in documents(spark).schema))


def empty(spark):
    return documents(spark).limit(0)


def texts(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")
