"""Operators for preparing text for language-model training, one module per operator."""
