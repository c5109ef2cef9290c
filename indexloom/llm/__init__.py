"""Operators for preparing training text at scale: ten DataFrame operators and their queries."""
