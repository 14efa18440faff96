"""Registered queries: every operator bound to the driver's tables, next to its SQL oracle."""
