"""The operators that differ on a streaming table: sources, de-duplication, windows, sinks.

The row-wise ones (fills, text, casts, time columns, batch columns) work on it unchanged.
"""
