"""Pipeline configuration and its compilation to DataFrames."""
