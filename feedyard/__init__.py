"""feedyard: catalog-feed ingest, catalog maintenance, job progress and change-event
fan-out, written as Spark DataFrame and Structured Streaming jobs."""

__version__ = "0.1.0"
