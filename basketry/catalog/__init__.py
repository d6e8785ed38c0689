"""All registered queries. Importing the modules registers them."""

from basketry.catalog import cleaning, encoding, learning, profiling, scoring, visits  # noqa: F401
from basketry.catalog.base import ORACLES, QUERIES  # noqa: F401
