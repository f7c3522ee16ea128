"""Analytics of file inventories, as Spark plans, and operators for training data."""
