"""Column, statistics, quantile and ordering helpers shared by the operators."""
