"""Reading and writing: files, database tables, incremental loads and model outputs."""
