"""Batch jobs: these run, write and report."""
