"""Operators for preparing training text: each module holds one, `pipeline` stages call five."""
