"""The catalogue: one query per operator and its SQL."""
