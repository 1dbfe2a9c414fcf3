"""Importing this module registers every query of the library."""

from .operators import addresses, authorisation, bitemporal, chain_execution, clauses, compare, conservation, context, documents, evaluation, execution, extraction, gates, grammar, identity, ledger, lineage, mapping, mapping_rules, matching, ordering, promotion, reconciliation, registries, resolver, safety, state, temporal  # noqa: F401
from .plans import chains  # noqa: F401
from .sources import selection  # noqa: F401
from .streaming import queries  # noqa: F401
