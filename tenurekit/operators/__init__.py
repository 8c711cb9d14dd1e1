"""DataFrame-in, DataFrame-out operators. None of them runs an action or collects to the driver."""
