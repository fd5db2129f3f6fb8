"""See the README for the layout of the package."""
