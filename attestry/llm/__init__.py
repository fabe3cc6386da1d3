"""Training-data operators: quality, similarity joins, packing, extraction, archives, sharding, dedup,
decontamination, toxicity and chat formatting. Nothing outside this subpackage imports it."""
