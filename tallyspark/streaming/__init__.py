"""Structured Streaming sync."""

from tallyspark.streaming.incremental import apply_landed_batch, start_sync, sync_into_table

__all__ = ["apply_landed_batch", "start_sync", "sync_into_table"]
