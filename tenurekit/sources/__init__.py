"""Readers, writers, extraction filters and the mapping of demo tables to the subscription schema."""
