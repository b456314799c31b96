"""Named queries over a directory of parquet tables, each with an independent SQL twin where SQL can state it."""
