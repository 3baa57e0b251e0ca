"""Plans that need more than one operator: size-checked joins and the end-to-end jobs."""
