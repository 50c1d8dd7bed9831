"""Operators for training-data pipelines: text, vectors, URLs and token files at corpus scale."""
