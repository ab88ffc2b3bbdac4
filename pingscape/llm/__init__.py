"""Operators for preparing language-model training text at corpus scale.

Nothing else in the library imports this subpackage.
"""
