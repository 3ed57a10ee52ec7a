"""JSON sources and sinks of tables and keyed values."""
