"""Small document tables with the odd rows that every operator must take."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, schema=SCHEMA, **extra):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema)


ODD = [None, "", " \n ", "a", "one two three four five six", "one two three four five six", "word " * 6000, "don't  stop\n\nnow 12 É日本 <|endoftext|>"]


def odd_docs(spark):
    """Odd texts, a null id, a repeated id and columns whose names operators might use."""
    rows = [(i, t, None if i % 2 else "en", "s", 0, 1.5, True) for i, t in enumerate(ODD)]
    rows += [(None, "no id here at all", None, None, None, None, None), (3, "a", "en", "s", 1, 0.5, False)]
    return spark.createDataFrame(rows, SCHEMA + ", Score double, held_out boolean")
