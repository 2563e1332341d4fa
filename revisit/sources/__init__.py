"""Readers for payloads and tables, writers for features and scores."""
