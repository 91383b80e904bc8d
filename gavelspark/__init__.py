"""Auction-listing analytics as Spark DataFrame operators."""
