"""Sources: file trees, manifests, git, and tables with explicit schemas."""
