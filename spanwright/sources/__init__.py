"""Table readers, schemas, idempotent sinks and integrity checks."""
