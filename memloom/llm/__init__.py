"""Training-data operators: licence scans, HTML extraction, WARC, language ID, decontamination, media
columns, secret scans, substring dedup, byte-level BPE and the n-gram Jaccard join. Nothing else in the
library imports this subpackage."""
