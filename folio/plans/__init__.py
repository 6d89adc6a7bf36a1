"""Whole conversions built from operators."""
