"""Training-data operators: quality rules, archives, fingerprints, packing, extraction, joins, scoring."""
