from .text import canonical_name, nfc, py_strip, shingles, words

__all__ = ["canonical_name", "nfc", "py_strip", "shingles", "words"]
