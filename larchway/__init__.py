"""Branchable, versioned analytics tables on Spark."""
