"""Part of the siteprism engine."""
