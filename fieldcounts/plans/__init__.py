"""Query bindings: views over the driver tables and the query registry."""
