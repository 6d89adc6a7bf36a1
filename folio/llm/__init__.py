"""Operators that prepare training data. Nothing outside this folder imports it."""
