"""Derived inputs, registered queries and their plain-SQL counterparts."""
