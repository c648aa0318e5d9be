"""Small document tables with every odd case: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

from pyspark.sql import DataFrame

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, g int, bucket string, id long, digest string"


def docs(spark, rows) -> DataFrame:
    """Rows of (doc_id, text), with columns beside them whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, "b", 3, "d") for i, t in rows], SCHEMA)


LONG = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
PASSAGE = " ".join(f"shared{i}" for i in range(40))
ODD = [
    (5, "alpha beta"), (7, "alpha beta"), (3, "alpha beta"), (1, None), (2, ""), (9, LONG), (4, "Alpha beta"), (6, f"start one {PASSAGE} end one"), (8, f"start two {PASSAGE} end two"),
    (8, f"start two {PASSAGE} end two"), (None, "no id here"), (None, f"other {PASSAGE}"), (10, " \t\n "), (11, "é́ ünïcode “quotes” 12,3\n\nnext  line"), (12, "<|endoftext|> it's a b\0c"),
]
