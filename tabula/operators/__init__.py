"""tabula.operators."""
