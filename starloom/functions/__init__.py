"""Column functions: text cleaning, hashing and small numeric helpers."""
