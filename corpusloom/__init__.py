"""Corpus and transmission-graph analytics as plain functions from DataFrames to DataFrames."""
