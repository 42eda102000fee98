"""Readers: lenient JSON lines, SQLite key-value stores, price lists, paged interfaces."""
