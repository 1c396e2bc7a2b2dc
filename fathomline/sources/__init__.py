"""Parsers of captured source answers into one schema of documents or items."""
