"""Archive operators: DataFrame to DataFrame."""
