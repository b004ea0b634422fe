"""Sources and sinks: landed pages, serialised batches, tables."""

from tallyspark.sources.batch import batch_length, parse_sync_batch, to_sync_batch
from tallyspark.sources.pages import (array_size, audit_pages, count_records, explode_pages, land_pages, pack_pages,
                                      read_landed_pages, split_faults, status_ok)
from tallyspark.sources.tables import (commit_table, init_partitioned, read_partitions, read_table,
                                       replace_partitions, restrict_partitions, scan, write_snapshot)

__all__ = [n for n in dir() if not n.startswith("_")]
