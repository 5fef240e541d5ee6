"""murmur: customer-messaging analytics as plain Spark DataFrame plans."""
