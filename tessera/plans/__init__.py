"""Whole plans: the batch model, and the projections of the fixtures that the queries share."""
