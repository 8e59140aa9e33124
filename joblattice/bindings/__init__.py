"""The operators bound to the test tables, and the same results as plain SQL."""
