"""Training-data operators: decontamination, similarity joins, quality
rules, archives, line / substring / suffix deduplication, packing, secret
scans and chat formatting, each a job over DataFrames."""
