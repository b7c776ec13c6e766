"""Inventory and pricing analytics over product listings, as Spark DataFrame jobs."""
