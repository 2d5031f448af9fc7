"""Topics on storage: the commit log, NDJSON files, memory, Kafka, and the registry of backends."""
