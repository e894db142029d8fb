"""End-of-day market time-series research on Spark: point-in-time features, signals, scans and studies over one long table."""
