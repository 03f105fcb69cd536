"""Input views over the driver's tables and the registered queries."""
