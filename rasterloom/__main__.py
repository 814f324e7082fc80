"""python -m rasterloom compress|compress-palette|pack|decompress|info SOURCE [TARGET]

SOURCE is a folder or file: anymaps and pictures to compress, containers to
decompress. TARGET mirrors the folders of SOURCE. Exits with 1 if any file fails, and
writes nothing where two files have one target.
"""

from __future__ import annotations

import sys

MODES = {"compress": 3, "compress-palette": 7, "pack": 1}


def main(args: list[str]) -> int:
    if len(args) < 2 or args[0] not in (*MODES, "decompress", "uncompress", "info") or (len(args) < 3) != (args[0] == "info"):
        print(__doc__, file=sys.stderr)
        return 1
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from rasterloom import api
    from rasterloom.operators import collection as co
    from rasterloom.sources.files import register

    spark = SparkSession.builder.appName("rasterloom").getOrCreate()
    register(spark)
    mode, source = args[:2]
    if mode == "info":
        rows = api.info(spark, source)
        rows.show(1000, truncate=False)
        return int(not rows.where("reason is not null").isEmpty())
    if mode in MODES:
        bad = api.encode_tree(spark, source, args[2], use_rle=bool(MODES[mode] & 2), use_palette=bool(MODES[mode] & 4))
    else:
        images = api.read(spark, source).persist()
        place = co.swap_suffix(co.below(spark, F.col("path"), source), ".pnm")
        images.where("reason is null").withColumn("path", place).write.format("pnm").mode("append").save(args[2])
        bad = images.where("reason is not null").select("path", "reason")
    failed = False
    for r in bad.toLocalIterator():
        failed = True
        print(f"{r.path}: {r.reason}", file=sys.stderr)
    return int(failed)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
