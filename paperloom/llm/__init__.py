"""Operators for building training corpora: packing, privacy, fingerprints, chat, language, toxicity, duplicates, leaks."""
