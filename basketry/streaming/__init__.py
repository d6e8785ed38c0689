"""Intentionally empty: the work this library covers is batch only (no watermarks, state or late data)."""
