"""The queries that the driver runs, by module, with their SQL."""
