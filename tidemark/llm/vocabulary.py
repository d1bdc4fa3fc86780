"""Place of the public vocabulary files."""

from __future__ import annotations


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Vocabulary file of the registered queries; other callers pass a path of their own."""
    import public_tokenizers

    return public_tokenizers.path(name)
