"""Operators over message tables: units, retrieval, ranking, merging, discovery."""
