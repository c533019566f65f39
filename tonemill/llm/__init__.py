"""Training-data operators: tokenizing, classifiers, near duplicates, dedup of
repeated passages, license scans, exact vector search and decontamination."""
