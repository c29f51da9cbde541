"""Training-data operators; nothing outside this subpackage imports it.

Each module holds one operator with its own general interface.  ``queries``
derives the contract columns of the registered queries from them.
"""
