"""The branchable store, test fixtures and the registered queries."""
