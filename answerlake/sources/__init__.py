"""Sources: parquet tables, text folders, CSV files, question lists, JDBC."""
