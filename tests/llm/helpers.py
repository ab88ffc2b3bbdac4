"""Small frames with the awkward rows that every operator must take."""

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Columns whose names operators use inside; inputs may carry them too.
CLASHING = ["n_words", "kept", "ids", "key", "component", "repeats", "text_stats", "size", "cut", "row_number", "label_id", "salt", "seq", "n"]


def documents(spark, rows, extra=()):
    """(doc_id, text) pairs as a documents table, with clashing extra columns on request."""
    full = [(i, t, "en", "s", len(t) if t is not None else None) + tuple(f"x{k}" for k in range(len(extra))) for i, t in rows]
    return spark.createDataFrame(full, DOC_SCHEMA + "".join(f", {c} string" for c in extra))
