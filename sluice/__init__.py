"""Sluice: analytics over Parquet tables and web pages, written for Spark."""
