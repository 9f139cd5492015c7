"""Operators for large training corpora: de-duplication, counting, scanning and auditing of text."""
