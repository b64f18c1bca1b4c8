"""Writers: partitioned tables that a later job can read back selectively."""
