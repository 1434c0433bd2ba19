"""Training-data operators. Nothing else in siteloom imports this subpackage."""
