"""Reading and writing observation files, inventories, manifests and result tables."""
