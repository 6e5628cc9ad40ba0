"""Document analytics on Spark: every operator is a DataFrame plan over ``(doc_id, pos, text)``."""
