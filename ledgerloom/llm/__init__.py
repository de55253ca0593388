"""Operators for preparing training text: near-duplicates, tokens, licences, secrets, fingerprints, leaks, toxicity, language and likelihood."""
