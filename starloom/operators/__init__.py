"""Operators of the warehouse: lazy frames in, lazy frames out."""
