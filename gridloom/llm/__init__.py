"""Operators that prepare training text: packing, counting, archiving, filtering and de-duplication."""
