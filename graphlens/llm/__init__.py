"""Training-data operators: ten stand-alone components and their contract queries."""
