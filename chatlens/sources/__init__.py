"""chatlens.sources."""
