"""Writers for panels, reports and manifests."""
