"""Column expressions: tokenizers, hashes, identifiers, scalar helpers."""
