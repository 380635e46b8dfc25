"""Operators for preparing training text at scale; nothing outside this subpackage imports it."""
