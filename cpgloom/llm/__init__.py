"""Operators tagged llm; nothing outside this folder imports them."""
