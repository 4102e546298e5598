"""Sources and sinks: text tables, key/value datasets (parquet, SequenceFile), target and family text, compaction."""
