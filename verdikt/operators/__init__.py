"""Operators of the scan and of signature maintenance."""
