"""tabula.plans."""
