"""tabula.streaming."""
