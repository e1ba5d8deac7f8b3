"""Where solutions come from: tables, triples, results files and endpoints.

A source has ``public_vars``, ``all_vars`` and ``solution(spark)``.
"""

from .tables import TableSource
from .triples import TriplesSource, triples_of_table

__all__ = ["TableSource", "TriplesSource", "triples_of_table"]
