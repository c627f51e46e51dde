"""DataFrame operators for generating, synthesising, anonymising and validating tables."""
