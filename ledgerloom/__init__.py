"""Ledger reconciliation and corpus preparation on Apache Spark."""
