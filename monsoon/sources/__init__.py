"""Table schemas, readers, adapters and sinks."""
