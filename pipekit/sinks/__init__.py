"""Writers: files, partitioned lakes, databases."""
