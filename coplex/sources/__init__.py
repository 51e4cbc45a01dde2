"""Posts, incidence tables, index layouts and manifests."""
