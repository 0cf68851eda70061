"""Operators over the flat conversation tables; every table has conv_id."""
