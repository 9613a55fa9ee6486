"""Parameter tables: windows, filterbanks and bases, computed on the driver and joined as small tables."""
