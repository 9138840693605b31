"""Operators for preparing training data at corpus scale.

Nothing else in the library imports this subpackage. ``quarry.llm.queries``
registers one query per operator; each module documents its method, its
result on degenerate input, and the bounds of what it broadcasts.
"""
