"""Templates, pipelines, fixture views and the registered queries."""
