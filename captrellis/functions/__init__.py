"""Column expressions: everything here is narrow and runs on batch or streaming rows."""
