"""What the tests of this folder share."""

from helpers import DATA, plain, same  # noqa: F401

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, source="s", lang="en"):
    """documents from texts or (doc_id, text) pairs."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, lang, source, len(t or "")) for i, t in rows], SCHEMA)
