"""Compare two forms of the provider chain on one session.

``at once`` joins all parsed snapshots (``resolve_keys``). ``in turn`` cuts each
snapshot down to the keys that no earlier provider answers before it is parsed
(``resolve_keys_in_turn``). Both run on the derived snapshots, where the first
provider answers about a quarter of the keys, and with a first provider made to
answer nine of ten.

Usage: python tools/compare_chain.py [sf_dir] [cores]
"""

from __future__ import annotations

import os
import sys
import time
from dataclasses import replace

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from shelfmark.derive import inputs as D  # noqa: E402
from shelfmark.operators import resolve as R  # noqa: E402
from shelfmark.operators.validate import valid_ids  # noqa: E402
from shelfmark.plans.registry import _providers  # noqa: E402
from shelfmark.session import local_session  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session(int(sys.argv[2]) if len(sys.argv) > 2 else 8, shuffle_partitions=16)
    providers = _providers(spark, sf)
    keys = R.counted(valid_ids(D.load(spark, sf, "raw_ids_large")))[0]
    body = F.format_string('{"ISBN:%s":{"title":"t"}}', F.col("isbn"))
    known = F.pmod(F.xxhash64("isbn"), F.lit(10)) > 0
    mostly = replace(providers[0], snapshot=providers[0].snapshot.select(
        "isbn", F.when(known, 200).otherwise(404).alias("status_code"), body.alias("body"), "fetched_at"))
    for case, chain in (("as derived", providers), ("nine of ten", [mostly, *providers[1:]])):
        for turn in range(3):
            for name, make in (("at once", R.resolve_keys), ("in turn", R.resolve_keys_in_turn)):
                t = time.perf_counter()
                make(keys, chain).write.format("noop").mode("overwrite").save()
                print(f"{case}, {name}, run {turn + 1}: {time.perf_counter() - t:.2f} s")
    spark.stop()


if __name__ == "__main__":
    main()
