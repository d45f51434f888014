"""Training-data operators. Nothing else in quern imports this package."""
