"""Reading tables, version manifests and checkpoints."""
