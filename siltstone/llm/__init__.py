"""Operators for building training data: counting, fingerprinting, deduplicating, labelling, mixing and encoding text."""
