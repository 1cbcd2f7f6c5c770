"""Operators for building language-model training corpora from document tables."""
