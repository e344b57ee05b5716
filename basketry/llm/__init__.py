"""Operators for preparing training text: mixing, quality, dedup, language, packing, archives.

Nothing else in the library imports this subpackage. Each module holds one
operator with its own general interface; ``queries`` registers one query per
operator (``opN_<name>``) and ``oracles`` the SQL for those that SQL can express.
"""
