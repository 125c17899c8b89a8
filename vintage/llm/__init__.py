"""Operators of a training-data pipeline over document tables.

Each module holds one operator with its own general interface; ``queries``
registers one query per operator over the whole tables. Nothing else in the
library imports this subpackage.
"""
