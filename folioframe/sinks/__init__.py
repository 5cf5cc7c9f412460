"""Writers: record tables to exchange formats."""
