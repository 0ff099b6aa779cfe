"""Small document tables with the awkward cases: nulls, empty and long texts, repeated rows, ties, extra columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, ids string, size string"


def rows(texts, langs=None, sources=None, ids=None):
    n = len(texts)
    return [
        (ids[i] if ids else i, t, langs[i] if langs else "en", sources[i] if sources else f"s{i % 3}", None if t is None else len(t), i, "x", "y")
        for i, t in zip(range(n), texts)
    ]


def frame(spark, texts, **kw):
    """Columns fp, ids and size clash with names that the operators use themselves."""
    return spark.createDataFrame(rows(texts, **kw), SCHEMA)


PROSE = "The cat sat on the mat and the dog lay by the door while rain fell on the old stone roof"
AWKWARD = [None, "", " \t\n", "one", PROSE, PROSE, PROSE + " again", "naïve café ñandú über Straße", "x" * 9000, ("lorem ipsum dolor " * 400).strip(), "   wide", "a\x1cb", "𝒳 astral 𝒴"]
