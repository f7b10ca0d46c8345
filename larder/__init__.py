"""Larder: stock replenishment and purchase-cost analytics on Spark DataFrames."""
