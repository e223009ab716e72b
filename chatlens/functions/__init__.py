"""chatlens.functions."""
