"""Writers in the formats that the sources read."""
