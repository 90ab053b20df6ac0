"""Operators for building training corpora at scale.

Nothing outside this subpackage imports it.  ``queries`` holds the registered
queries; the other modules hold one operator each.
"""
