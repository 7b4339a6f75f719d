"""Streams of schema notifications, collection events and transactions, with results and state on shared storage."""
