"""A link library on Spark: extract, normalise, deduplicate, classify and query web links."""
