"""tabula.sources."""
