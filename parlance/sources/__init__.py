"""Readers that turn exports and feeds into message tables."""
