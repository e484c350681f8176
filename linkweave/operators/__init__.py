"""DataFrame to DataFrame operators. None of them brings rows to the driver."""
