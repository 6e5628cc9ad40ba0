"""Operators over the central table ``lines(doc_id, pos, text)`` and what is made of it."""
