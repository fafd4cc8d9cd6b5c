"""DataFrame -> DataFrame operators for every metric."""
