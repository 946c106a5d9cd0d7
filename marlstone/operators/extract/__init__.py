"""Extraction: one document in, Markdown, tables, figures, references or symbols out."""
