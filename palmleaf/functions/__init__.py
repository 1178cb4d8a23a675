"""Part of the palmleaf engine; see the README for the inventory."""
