"""Airline operations analytics on PySpark: reports, listings, request tables and change feeds."""
