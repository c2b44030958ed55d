"""Operators for preparing training data at corpus scale.

Nothing else in the library imports this subpackage.  Each module holds one
operator with its own general interface; :mod:`keelstone.llm.queries` registers
the thin contract queries over the standard tables.
"""
