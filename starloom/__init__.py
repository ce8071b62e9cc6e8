"""Starloom: Spark jobs that profile, clean, featurise, model and score rated texts."""
