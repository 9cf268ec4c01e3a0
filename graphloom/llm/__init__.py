"""Operators for preparing training text at scale. Nothing else in graphloom imports this package."""
