"""Whole plans, and the queries of the driver."""
