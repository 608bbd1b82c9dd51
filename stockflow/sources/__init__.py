"""Reading, writing and deriving the five tables."""
