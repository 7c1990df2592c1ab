"""Operators for preparing training text at scale; the rest of the library never imports this package."""
