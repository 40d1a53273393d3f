"""Operators for preparing large text corpora.

Nothing else in the library imports this subpackage.  ``registry`` names the
queries; every operator lives in a module of its own.
"""
