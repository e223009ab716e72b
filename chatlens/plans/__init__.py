"""chatlens.plans."""
