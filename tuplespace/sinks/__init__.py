"""Writers: delimited text (the reference's layouts) and Parquet tables."""
