"""Training-data operators: language ID, URL filters, WARC, decontamination, near-dedup,
licence scans, passage dedup, preference formatting, packing and exact top-k search.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries when it is there.
"""
