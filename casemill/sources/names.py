"""Column names."""

from __future__ import annotations

import unicodedata


def cleaned_name(name: str) -> str:
    """A column title in lower case without accents or punctuation marks, blanks as underscores."""
    folded = unicodedata.normalize("NFD", name.lower()).encode("ascii", "ignore").decode()
    for mark in ".-":
        folded = folded.replace(mark, "")
    folded = folded.replace(",", " ")
    for mark in "/()+":
        folded = folded.replace(mark, f" {mark} ")
    return "_".join(folded.split())
