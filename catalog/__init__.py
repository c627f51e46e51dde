"""The registered queries: each family pairs a Spark query with its SQL check."""
