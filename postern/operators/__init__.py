"""Operators on messages: parse, report, classify, reduce."""
