"""Training-data operators: token files, media archives, packing, tokenising, scans, dedup, WARC.

Nothing outside this subpackage imports it.  Every operator reads whole tables and whole texts,
keeps intermediates in the shared folder named by ``spark.checkpoint.dir`` and survives the loss of
an executor: files are written under a task's own name and renamed, tables by Spark's committer.
"""
