"""Operators for preparing training data. Nothing else in weftline imports this."""
