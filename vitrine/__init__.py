"""Vitrine: store search, order desk and conversation data on Spark DataFrames."""
