"""Model fits: Spark sums the sufficient statistics, the driver solves small systems."""
