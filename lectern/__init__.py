"""Retrieval, audit and state operators over document collections, written for Spark."""
