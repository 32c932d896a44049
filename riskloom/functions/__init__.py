"""Column functions: cleaning, scalar expressions, pseudonyms."""
