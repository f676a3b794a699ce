"""Compositions of operators that cover a whole harmonization run."""
