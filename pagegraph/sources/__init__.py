"""Where graphs come from and go to: wiki dumps, tables, Parquet and legacy binary files."""
