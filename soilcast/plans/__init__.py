"""End-to-end flows on the observation fixture, the registered queries and their SQL oracles."""
