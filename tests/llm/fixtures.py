"""Small tables with every awkward row: nulls, empty and long texts, ties, repeats, clashing names."""

from pyspark.sql import functions as F

PROSE = "The quick brown fox jumps over the lazy dog while seven small boats drift along the quiet river towards the old mill. "
TEXTS = [
    (0, PROSE * 4),
    (1, PROSE * 4),
    (2, PROSE * 4 + "One more word."),
    (3, "short"),
    (4, ""),
    (5, None),
    (None, "no id here, only words"),
    (7, "é ü 中文 😀 words\nand\tlines\r\n\x0bodd \x0c spaces  "),
    (8, "x" * 3000),
    (9, "word " * 5000),
    (10, " \n \t "),
    (11, "A b C d e F"),
    (11, "A b C d e F"),
    (12, "a B c D E f"),
]
CLASHING = ("component_id", "fp", "score", "row", "spans", "media", "piece", "salt", "copy", "pii", "th", "n", "host", "words", "length", "src", "parts", "table", "found", "kinds", "new", "mark_id", "stays", "root", "hit_id", "gone", "block", "good", "label_id", "__id", "__table", "__found", "__th", "__again", "__src", "__u", "__n", "__kinds", "__new", "__node", "__fp")


def documents(spark, texts=TEXTS, extra=True):
    df = spark.createDataFrame([(i, t, "en", None if n % 5 == 0 else f"src{n % 3}", len(t) if t else 0) for n, (i, t) in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.lit(-1).alias(c) for c in CLASHING)) if extra else df


def empty(spark):
    return documents(spark).limit(0)
