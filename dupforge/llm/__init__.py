"""Operators for preparing training text: one module each, no operator imports another but for the shared helpers."""
