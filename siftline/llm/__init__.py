"""Operators for preparing language-model training data at cluster scale.

Nothing outside this folder imports it; the whole folder can be removed.
"""
