"""Part of the voxelbrick library."""
