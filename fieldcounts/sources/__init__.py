"""Sources and sinks: wide survey sheets, delimited tables, Parquet, JDBC."""
