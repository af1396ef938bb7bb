"""Operators for preparing language-model training data, ten of them, each a
module of its own.  Nothing else in the library imports this subpackage."""
