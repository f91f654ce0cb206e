"""Plan helpers: sessions, lineage cuts and table access."""
