"""Retail visit analytics on PySpark.

Scan lines go in (one row per product scanned, returns as negative counts); cleaned lines, profiles, one
feature row per visit, trained multiclass models and a probability per class per visit come out.
"""
