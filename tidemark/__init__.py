"""Keyed-record, namespace, log and health analytics on PySpark."""
