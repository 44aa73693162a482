"""Training-data operators: tokens, packing, mixing, quality, media, licences, WARC, near duplicates.

Nothing outside this subpackage imports it. Every operator takes and returns DataFrames; files that an
operator writes go below the folder that the session names in ``spark.checkpoint.dir``.
"""
