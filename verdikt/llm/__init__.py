"""Operators that prepare text for language-model training.

Everything here is optional: no other part of the library imports this
subpackage, and removing the folder leaves the rest working.
"""
