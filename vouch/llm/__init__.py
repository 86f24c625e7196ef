"""Operators for preparing training text at corpus scale.

Each module holds one operator with its own general interface; the module
``queries`` applies them to the given tables.  Nothing outside this package
imports it.
"""
