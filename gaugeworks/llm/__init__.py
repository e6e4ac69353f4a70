"""Operators for preparing training text: dedup, decontamination, packing, scoring, archives."""
