"""Test inputs and queries over the sales-style tables: customers stand for tracts."""
