"""Operators for large training-data pipelines; nothing outside imports them but the driver entry and the corpus pipeline."""
