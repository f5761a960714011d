"""Conversation search, link discovery and corpus preparation as Spark jobs."""
