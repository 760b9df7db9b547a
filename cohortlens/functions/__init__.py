"""Column expressions: text-to-number rules, probability vectors, keyed hashes."""
