"""User-behaviour analytics on Spark: ingest, dedup, metrics, telemetry, live views."""
