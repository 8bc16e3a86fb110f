"""Operators for preparing training text: each module holds one, and its thin query over the driver's tables."""
