"""Readers, writers, profiling and drift checks for raw and canonical logs."""
