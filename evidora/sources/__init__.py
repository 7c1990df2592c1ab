"""Document sources and the versioned table store."""
