"""Veritrail: bitemporal, tamper-evident record analytics expressed as lazy Spark plans."""
