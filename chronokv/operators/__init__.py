"""Relational operators over change logs, replicated logs, event streams and metrics."""
