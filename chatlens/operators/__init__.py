"""chatlens.operators."""
