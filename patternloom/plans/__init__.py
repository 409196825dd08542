"""The whole analysis as one plan."""
