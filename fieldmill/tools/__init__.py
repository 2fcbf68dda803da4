"""Tools around the engine: golden tests, synthetic records, the command line."""
