"""The per-document plans over file streams."""
