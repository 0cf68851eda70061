"""Conversation-signal analytics on Spark."""
