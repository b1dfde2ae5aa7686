"""Plan-level helpers: sessions, shared folders, lineage cuts and iterative plans."""
