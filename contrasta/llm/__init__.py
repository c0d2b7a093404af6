"""Training-data operators: classifiers, joins, scans, search, mixing and packing over large corpora."""
