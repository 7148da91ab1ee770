"""Second formulations of the registered queries, for checking."""
