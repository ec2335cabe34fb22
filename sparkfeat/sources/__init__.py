from sparkfeat.sources.staging import (
    checked_broadcast, clear_staging, stage, stage_bucketed, staged, staging_root, staging_scope,
)
from sparkfeat.sources.tables import read_table, write_table

__all__ = ["checked_broadcast", "clear_staging", "read_table", "stage", "stage_bucketed", "staged", "staging_root", "staging_scope",
           "write_table"]
