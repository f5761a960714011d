"""Whole query plans made of operators."""
