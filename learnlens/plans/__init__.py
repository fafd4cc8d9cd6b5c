"""Query plans: the metric catalogue and the registered queries."""
