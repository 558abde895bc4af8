"""Operators for preparing training corpora; every query and its SQL is registered in ``queries``."""
