"""Functions over columns and tables that several operators share."""
