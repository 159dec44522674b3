"""Readers: the supplied Parquet tables and the reference's text/binary layouts."""
