"""Writers: partitioned lake tables and the single-file layout of exports."""
