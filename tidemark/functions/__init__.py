"""Building blocks of the mirror engine."""
