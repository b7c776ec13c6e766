"""Reading listings and writing tables."""
