"""Training-data operators: tokenising, ranking, sharding, deduplication, decontamination, personal data,
HTML extraction, quality rules and chat formatting. Nothing else in the library imports this subpackage."""
