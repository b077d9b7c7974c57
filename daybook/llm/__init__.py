"""Operators that prepare a text corpus for training a language model.

Each module holds one operator with a general interface; ``queries`` registers
the thin queries on top of them. Nothing outside this subpackage imports it.
"""
