"""Nothing streams in the modelled tool: its tables are built and read in batches."""
