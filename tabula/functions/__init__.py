"""tabula.functions."""
