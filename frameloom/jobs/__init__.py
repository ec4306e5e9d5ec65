"""Sessions and the registered queries."""
