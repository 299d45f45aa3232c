"""Every query of the library by name, with its SQL oracle where SQL can express it."""

from __future__ import annotations

from lamina.plans import base, document_queries, element_queries, fill_queries, lookup_queries, merge_queries, normal_queries, output_queries, package_queries, scalar_queries

QUERIES, ORACLES = base.QUERIES, base.ORACLES
MODULES = (element_queries, scalar_queries, document_queries, output_queries, lookup_queries, package_queries, merge_queries, fill_queries, normal_queries)
