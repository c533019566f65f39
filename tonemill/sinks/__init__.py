"""Writers: CSV exports and confidence-tier folders."""
