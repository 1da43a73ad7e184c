"""Statistics: sufficient statistics by distributed aggregates, closed forms in numpy on the driver."""
