"""Operators on training text and source: kept apart, nothing else imports them."""
