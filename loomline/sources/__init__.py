"""Readers and writers; every path goes through Spark's file systems."""
