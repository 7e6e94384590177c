"""Types, table schemas and decode plans derived from interface definitions."""
