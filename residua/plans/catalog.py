"""All named queries."""

from residua.plans import (  # noqa: F401  (importing registers the queries)
    align_queries,
    cluster_queries,
    file_queries,
    format_queries,
    genome_queries,
    kmer_queries,
    listing_queries,
    search_queries,
    table_queries,
)
from residua.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
