"""Plan-level helpers: durable cut points, surrogate row ids."""
