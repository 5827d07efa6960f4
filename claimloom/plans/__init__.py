"""Query registry, SQL catalog and end-to-end flows."""
