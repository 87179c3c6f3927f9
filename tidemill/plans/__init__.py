"""Tables that cut lineage, and the registered queries."""
