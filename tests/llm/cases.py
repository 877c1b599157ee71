"""Small tables that the tests share."""
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType())])


def documents(spark, texts, ids=None, extra=()):
    """``documents`` with the given texts; ``extra`` names more columns, all of them null."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en" if n % 2 else None, f"s{n % 3}" if n % 5 else None,
             None if t is None else len(t), *([None] * len(extra)))
            for n, (i, t) in enumerate(zip(ids, texts))]
    schema = T.StructType([*DOCS.fields, *(T.StructField(e, T.StringType()) for e in extra)])
    return spark.createDataFrame(rows, schema)


CLASHING = ("fp", "score", "key", "v", "o", "block", "_text", "_mark", "_gone", "topic", "_rate",
            "owners", "word")
ODD_IDS = [None, 3, 3, 7, None, 7, 9]
ODD_TEXTS = [None, "", "", "a line of some words that is long enough to count here",
             "x " * 50_000, "a line of some words that is long enough to count here", "é\n\n\t "]
