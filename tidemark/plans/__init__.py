"""Plan-level constructions: lazy pipelines and order-dependent scans that distribute."""
