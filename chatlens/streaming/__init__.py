"""chatlens.streaming."""
