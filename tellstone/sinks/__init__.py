"""Writers of tables, records and graphs."""
